"""The query of every operator, over its whole table, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, embed_dedup, exact_dedup, html_text, language, near_dedup, packing, quality, runs, search, secrets, token_files, toxicity
from .common import remainder

#: The public vocabularies; no copy is kept here.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "op6_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
        doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d""",
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def _scored(docs: DataFrame, model, with_score: Callable[[DataFrame, object], DataFrame], modulus: int, held: int) -> DataFrame:
    out = with_score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return _scored(docs, model, toxicity.with_score, 3, 1)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return _scored(docs, model, quality.with_score, 5, 0)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _either_case(words: str) -> str:
    """A pattern whose letters match in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _spans_sql(pattern: str, kind: int, group: int = 0, keep: str = "true") -> str:
    """A list of (start, kind, end, text): the gaps between matches and the matches alternate."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
            's': list_sum(list_transform((regexp_split_to_array(t, '{pattern}'))[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform((regexp_extract_all(t, '{pattern}'))[1:i - 1], lambda x: length(x))), 0),
            'k': {kind},
            'n': length((regexp_extract_all(t, '{pattern}'))[i]),
            'x': (regexp_extract_all(t, '{pattern}', {group}))[i]}}), lambda y: {keep})"""


_ASSIGN_SQL = f"({_either_case('password')}|{_either_case('passwd')}|{_either_case('secret')}|{_either_case('token')}|{_either_case('api')}_?{_either_case('key')})"
_ASSIGN_SQL += r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOW_SQL = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}|0123456789"
    f"|{_either_case('abcdefghij')}|{_either_case('example')}|{_either_case('placeholder')}|[xX]{{8}}|^[A-Za-z/_=+-]*[0-9]{{0,4}}$"
)
_PEAK_SQL = """list_max(list_transform(range(1, length(y.x) - 18), lambda i: -list_sum(list_transform(
            list_distinct(string_split(substr(y.x, i, 20), '')),
            lambda c: (20 - length(replace(substr(y.x, i, 20), c, ''))) / 20.0 * log2((20 - length(replace(substr(y.x, i, 20), c, ''))) / 20.0)))))"""
_RANDOM_SQL = (
    f"regexp_matches(y.x, '[0-9]') AND regexp_matches(y.x, '[A-Za-z]') AND NOT regexp_matches(y.x, '{_ALLOW_SQL}') "
    f"AND {_PEAK_SQL} >= CASE WHEN regexp_full_match(y.x, '[0-9a-fA-F]+') THEN 3.0 ELSE 3.75 END - 1e-9"
)
_SPELL_SQL = "array_to_string(list_transform(list_sort({0}), lambda y: ['assign', 'access', 'hex', 'entropy'][y.k + 1] || ':' || y.s::BIGINT || ':' || (y.s + y.n)::BIGINT), ',')"


@query(
    "op7_secrets",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (
        SELECT doc_id, {_spans_sql(_ASSIGN_SQL, 0, 2, "length(y.x) >= 8")} AS a, {_spans_sql("AKIA[A-Z0-9]{12,}", 1)} AS c,
            {_spans_sql("[0-9a-f]{32,}", 2)} AS h, {_spans_sql("[A-Za-z0-9+/_=-]{20,}", 3, 0, _RANDOM_SQL)} AS e
        FROM d),
    b AS (SELECT *, a || c || h AS base FROM f),
    g AS (SELECT *, list_filter(e, lambda y: len(list_filter(base, lambda z: z.s <= y.s AND y.s + y.n <= z.s + z.n)) = 0) AS more FROM b)
    SELECT doc_id, len(a) AS n_assign, len(c) AS n_access, len(h) AS n_hex,
        sha256({_SPELL_SQL.format("base")}) AS base_sha256, {_SPELL_SQL.format("base || more")} AS spans
    FROM g""",
)
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = secrets.spelled(F.filter("spans", lambda x: x["kind"] < 3))
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"),
    )


@query(
    "op2_embedding_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    ok AS (
        SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
        WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
    r(id, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b),
    c AS (SELECT id, min(m) AS m FROM r GROUP BY id)
    SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept
    FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
)
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op8_minhash_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
            lambda x: x <> '') AS w
        FROM documents),
    s AS (
        SELECT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g
        FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
        GROUP BY x.doc_id, y.doc_id),
    l AS (
        SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
    r(id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b),
    c AS (SELECT id, min(m) AS m FROM r GROUP BY id)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
    FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
)
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents"))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def _repeating(docs: DataFrame) -> DataFrame:
    """`docs` with a period put into a tenth of the texts: from word a on, the p words from there are repeated.

    With h the crc32 of the id and g = h div 10, that is done where h mod 10 is 0, with a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8); n is the number of words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    counted = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    placed = counted.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.slice(F.flatten(F.array_repeat(F.expr("slice(w, int(a + 1), int(p))"), F.expr("int((n - a + p - 1) div p)"))), F.lit(1), F.expr("int(n - a)"))
    text = F.concat_ws(" ", F.expr("slice(w, 1, int(a))"), tail)
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query(
    "op11_runs",
    r"""
    WITH t AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            doc_id::VARCHAR AS s
        FROM documents),
    h AS (
        SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(
            [4294967295::BIGINT] || list_transform(range(8 * length(s)), lambda k: (ascii(s[(k // 8 + 1)::INT]) >> (k % 8)::INT) & 1),
            lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) AS h
        FROM t),
    a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN h // 10 % n ELSE 0 END AS a FROM h),
    d AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i:
            w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
        FROM a),
    i AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
    m AS (SELECT p.doc_id, q.i - p.i AS q, p.i FROM i p JOIN i q ON p.doc_id = q.doc_id AND p.x = q.x AND q.i > p.i AND 4 * (q.i - p.i) <= p.n),
    l AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
    r AS (
        SELECT doc_id, s, l, min(q) AS q FROM (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM l GROUP BY doc_id, q, k)
        WHERE l >= 6 AND l >= 4 * q GROUP BY doc_id, s, l),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) AS n FROM r),
    b AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS f,
            list({'a': s + q, 'b': s + l}) AS gone, max(s) FILTER (n = 1) AS s, max(l) FILTER (n = 1) AS l, max(q) FILTER (n = 1) AS q
        FROM o GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
        sha256(coalesce(f, '')) AS runs_sha256,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN d.w ELSE list_transform(list_filter(range(d.n), lambda i:
            len(list_filter(gone, lambda y: i >= y.a AND i < y.b)) = 0), lambda i: d.w[i + 1]) END, ' ')) AS collapsed_sha256
    FROM d LEFT JOIN b ON b.doc_id = d.doc_id""",
)
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_repeating(table(spark, sf_dir, "documents")))
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  the sign of x's exponent less y's
    order = lambda x, y: F.coalesce(F.nullif(F.signum(more(y, x)), F.lit(0.0)), F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"])).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op12_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents),
    s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
    i AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark),
    p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
    f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
    c AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM i JOIN p ON p.t = i.t JOIN f ON f.t = i.t, s GROUP BY item_id, doc_id)
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c WHERE score > 0) WHERE rank <= 10""",
)
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return language.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
