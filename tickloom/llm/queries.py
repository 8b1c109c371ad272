"""One registered query for each operator, over its whole table, and its SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    exact,
    lexical,
    minhash,
    mixing,
    pieces,
    quality_lm,
    repeats,
    rules,
    secrets,
    sharding,
    toxicity,
    url_filter,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A public vocabulary; only the driver reads the file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op4_exact_dedup",
    f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id,
  count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@query(
    "op5_mix_sources",
    r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, ((place - 1) % 3 + 1)::DOUBLE AS weight FROM per_source),
levels AS (
  SELECT *,
    ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER filling)::BIGINT - cap, 0))::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, place
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
  WINDOW filling AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(weight * max(CASE WHEN cap > weight * level THEN level END) OVER (), 0.0))
      AS target,
    ('0x' || substr(md5('7:' || coalesce('=' || source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(s.doc_id::VARCHAR), s.doc_id) - 1 AS k
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, (floor((k + 1) * rate + u) - floor(k * rate + u))::BIGINT AS copies FROM ranked)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM taken
""",
)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))


@query(
    "op6_quality_rules",
    rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
starts AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams)
  WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM starts)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaim
  FROM w LEFT JOIN covered USING (doc_id)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    array_to_string(list_filter([
      CASE WHEN n_words < 20 THEN 'few_words' END,
      CASE WHEN word_chars::DOUBLE < n_words * 2.0::DOUBLE OR word_chars::DOUBLE > n_words * 20.0::DOUBLE
        THEN 'word_length' END,
      CASE WHEN n_symbols::DOUBLE > n_words * 0.1::DOUBLE THEN 'symbols' END,
      CASE WHEN n_exclaim::DOUBLE > n_words * 0.5::DOUBLE THEN 'shouting' END,
      CASE WHEN n_stop_words::DOUBLE < n_words * 0.02::DOUBLE THEN 'stop_words' END,
      CASE WHEN n_dup_lines::DOUBLE > n_lines * 0.5::DOUBLE THEN 'repeated_lines' END,
      CASE WHEN n_repeat_words::DOUBLE > n_words * 0.3::DOUBLE THEN 'repeated_words' END
    ], lambda x: x IS NOT NULL), ',') AS broken
  FROM m)
SELECT *, NOT base_failed AND broken = '' AS kept FROM v
""",
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(documents(spark, sf_dir))
    verdict = F.col("verdict")
    return judged.select(
        "row.doc_id",
        *[verdict[name].alias(name) for name in rules.METRICS],
        verdict["base_failed"].alias("base_failed"),
        F.array_join(verdict["broken"], ",").alias("broken"),
        verdict["kept"].alias("kept"),
    )


_OWNERS = ", ".join(map(str, sharding.lookup_table(SHARDS)))


@query(
    "op9_shard_documents",
    f"""
SELECT doc_id, slot, 'shard-' || lpad(([{_OWNERS}])[slot + 1]::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot
      FROM documents)
""",
)
def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shard each document goes to; no text is read for that."""
    placed = sharding.place(documents(spark, sf_dir).select("doc_id"), SHARDS)
    return placed.select("row.doc_id", "slot", "shard")


def _spans_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Matches with their places: pieces between matches and matches add up to the text."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + size AS stop FROM (
    SELECT doc_id, i, size, measured,
      sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) - size AS start
    FROM (
      SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(list_transform(m, lambda x: length(x))) AS size,
        unnest(list_transform(g, lambda x: length(x))) AS measured,
        unnest(list_transform(p[1:len(m)], lambda x: length(x))) AS gap
      FROM (SELECT doc_id, regexp_extract_all(text, $p${pattern}$p$, 0) AS m,
              regexp_extract_all(text, $p${pattern}$p$, {group}) AS g,
              string_split_regex(text, $p${pattern}$p$) AS p
            FROM t)))
  WHERE measured >= {least}"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_PLAIN = {
    "assign": (rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
_SPAN_PARTS = [
    _spans_sql(rule.kind, place, *_PLAIN.get(rule.kind, (rule.pattern, rule.group, rule.least)))
    for place, rule in enumerate(secrets.RULES)
]


@query(
    "op10_secret_scan",
    f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_SPAN_PARTS)}),
b AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)
      FILTER (place < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN b USING (doc_id)
""",
)
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    found = found.select("row.doc_id", secrets.summary(F.col("spans")).alias("s"))
    return found.select("doc_id", "s.*")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a model is trained. Tests hold its scores against the held-out labels."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query(
    "op8_minhash_dedup",
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
  LEFT JOIN n USING (doc_id)
""",
)
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), size=3, percent=85)


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the digest of the text that they decode to.

    No SQL: it has no such search. Tests hold the ids against a search over the whole text and the
    digest against the text's own.
    """
    vocabulary = pieces.read_vocabulary(VOCABULARY)
    encoded = pieces.encode(documents(spark, sf_dir), vocabulary)
    return pieces.decode(encoded, vocabulary).select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256")
    )


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that ``labels`` calls good. No SQL: tests hold the scores against
    a plain model on small texts, and the verdicts against held-out labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_lm.classify(documents(spark, sf_dir), labels.where("quality = 1"))


@query(
    "op7_repeated_passages",
    """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM t WHERE len(h) >= 100)),
f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM w) WHERE m < doc_id),
i AS (
  SELECT doc_id, i,
    CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh
  FROM f),
s AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM i)
  GROUP BY doc_id, g),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
k AS (
  SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS z,
    sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM p JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
""",
)
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(documents(spark, sf_dir))
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]
    )
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: it has no eigenvectors. Tests hold it against another eigenvalue routine, and the
    counts and deviations against whole numbers."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = found.select("row.vec_id", "n", "deviation", F.explode("components").alias("c"))
    return each.select(
        "vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "c.identity_error"
    )


def _fixed_sql(what: str) -> str:
    """The longest of the fixed rules that fits, as a CASE."""
    whens = []
    for verdict, rule in sorted(url_filter.FIXED, key=lambda r: -len(r[1])):
        host, _, start = rule.partition("/")
        value = rule if what == "rule" else verdict
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{start}')"
        whens.append(f"WHEN {fits} THEN '{value}'")
    return f"CASE {' '.join(whens)} END"


def _tokens_sql(kind: str, text: str, cut: str) -> str:
    return (
        f"list_transform(list_filter(string_split_regex({text}, '{cut}'), "
        f"lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')), lambda t: '{kind}:' || t)"
    )


@query(
    "op12_url_filter",
    rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (
  SELECT page_id, host, path, {_fixed_sql("rule")} AS rule, {_fixed_sql("verdict")} AS fixed,
    TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})([^0-9]|$)', 1) AS BIGINT) AS doc_id,
    list_sort(list_distinct(list_concat(list_concat(
      {_tokens_sql("scheme", f"translate(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '{_UPPER}', '{_UPPER.lower()}')", ":")},
      {_tokens_sql("host", "host", "[.]")}), list_concat({_tokens_sql("path", "path", "[/._-]")},
      list_concat({_tokens_sql("query", r"regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)", "[&=]")},
      {_tokens_sql("tail", "regexp_extract(url, '^[^#]*#(.*)$', 1)", "[&=/]")}))))) AS tokens
  FROM h),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 'block' WHEN quality = 1 OR toxic = 0 THEN 'allow' END) AS label
  FROM labels GROUP BY doc_id),
b AS (SELECT row_number() OVER () AS id, tokens, label FROM t JOIN l USING (doc_id) WHERE label IS NOT NULL),
least AS (SELECT ceil({url_filter.SUPPORT} * count(*)) AS least FROM b),
frequent AS (
  SELECT token FROM (SELECT unnest(tokens) AS token FROM b) GROUP BY token
  HAVING count(*) >= (SELECT least FROM least)),
fb AS (
  SELECT b.id, any_value(label) AS label, list(token ORDER BY token) AS tokens
  FROM (SELECT id, label, unnest(tokens) AS token FROM b) b JOIN frequent USING (token) GROUP BY b.id),
subsets AS (
  SELECT id, label, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS rule
  FROM (SELECT id, label, tokens, unnest(range(1, (1 << len(tokens))::BIGINT)) AS mask FROM fb)),
counted AS (
  SELECT rule, count(*) AS times, count(*) FILTER (label = 'block') AS block, count(*) FILTER (label = 'allow') AS allow
  FROM subsets GROUP BY rule),
rules AS (
  SELECT rule, verdict, n, n::DOUBLE / times AS confidence
  FROM (SELECT rule, times, unnest(['block', 'allow']) AS verdict, unnest([block, allow]) AS n FROM counted)
  WHERE n >= (SELECT least FROM least) AND n > 0 AND n::DOUBLE / times >= {url_filter.CONFIDENCE}),
keys AS (
  SELECT *, row_number() OVER (ORDER BY confidence DESC, n DESC, array_to_string(rule, ' '), verdict <> 'block', verdict) AS place
  FROM rules),
f AS (SELECT coalesce(list(token), []) AS known FROM frequent),
sets AS (SELECT DISTINCT list_sort(list_intersect(tokens, known)) AS own FROM t, f),
best AS (SELECT own, min(place) AS place FROM sets JOIN keys ON list_has_all(own, rule) GROUP BY own)
SELECT page_id, host, path, t.rule, coalesce(fixed, k.verdict, '{url_filter.OTHERWISE}') AS verdict,
  CASE WHEN fixed IS NULL THEN array_to_string(k.rule, ' ') END AS mined
FROM (SELECT *, list_sort(list_intersect(tokens, known)) AS own FROM t, f) t
  LEFT JOIN best USING (own) LEFT JOIN keys k USING (place)
""",
)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = url_filter.judge(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("row.page_id", "host", "path", "rule", "verdict", "mined")


_TERMS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    "op13_ranked_search",
    f"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM d),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (
  SELECT no, doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT no, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY no, doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, s GROUP BY term),
scored AS (
  SELECT item_id, no, any_value(doc_id) AS doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM p JOIN q USING (term) JOIN w USING (term), s GROUP BY item_id, no),
r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.rank(documents(spark, sf_dir), items)
