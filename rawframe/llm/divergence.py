"""How far the sources of a language differ in the terms they use.

Terms are counted where texts are read, and dealt into shards by language and term. DuckDB sums a
shard's counts and keeps the terms that enough documents of the language have; Spark adds up what
a group (language and source) holds. In a second pass DuckDB gives each shard's part of the
divergence of each pair of sources, and its best terms; Spark merges sums and rankings.

A pair's divergence runs over all kept terms of its language, most of which few sources have. So a
shard sums only what terms in both sources add to the value they would have if each were counted alone:
f(a, b) - f(a, 0b) - f(0a, b) + f(0a, 0b), where 0 stands for a count of zero. The rest follows from each
source's own counts: how many terms it has how often. All numbers are whole, and so are their sums.

Defined results: null texts, languages and sources count as ''; a repeated row is one more document;
a group without terms gives every kept term a count of zero; a language without kept terms gives its
pairs the value 0 and no terms; ties go to the item whose UTF-8 bytes come first; an empty table gives no
rows; other columns aren't looked at. A text is held whole in its task, and DuckDB may spill in a task.
"""

from __future__ import annotations

import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, read_table, stage_table

#: A term is kept if so many documents of its language have it.
LEAST_DOCUMENTS = 3
#: The best terms of a group.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Distinct (language, source, term) a task holds before it hands its counts on.
COUNTED_TERMS = 400_000
#: A shard gets about so many counts.
SHARD_COUNTS = 500_000
#: Memory of a shard's DuckDB; beyond it spills.
SHARD_MEMORY = "400MB"

#: What each byte of a text counts as: capitals as small letters, bytes of terms as themselves, all others as a space.
_AS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and of what isn't ASCII, only A to Z lower-cased."""
    return text.translate(_AS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of parts of docs: occurrences in a group, and documents of the
    language that have the term, which stand in the row of any one of its groups."""
    filled = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        has: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in counts.items():
                docs = [has[lang].pop(t, 0) for t in n]
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            counts.clear()
            has.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = terms_of(text)
                counts[lang, source].update(terms)
                has[lang].update(set(terms))
            if sum(map(len, counts.values())) >= COUNTED_TERMS:
                yield from out()
        yield from out()

    return map_arrow(filled, run, "lang string, source string, term string, n bigint, docs bigint")


def _in_duckdb(rows: DataFrame, shards: int, schema: str, *queries: str) -> DataFrame:
    """The queries' rows of each shard, which is the table `shard` to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": SHARD_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as db:
            made = False
            for batch in batches:
                one = pa.Table.from_batches([batch])  # noqa: F841 (DuckDB reads it by its name)
                db.execute("INSERT INTO shard FROM one" if made else "CREATE TABLE shard AS FROM one")
                made = True
            for query in queries if made else ():
                yield from db.sql(query).to_arrow_reader(1 << 16)

    return map_arrow(rows.repartition(shards, "lang", "term"), run, schema)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, first), staged: counts of the terms that at least so many documents of a language have. One row of each term is its first."""
    counted = stage_table(count_terms(docs), "terms")
    found = _in_duckdb(
        counted,
        shard_count(counted),
        "lang string, source string, term string, n bigint, first boolean",
        f"""
        SELECT lang, source, term, n, source = min(source) OVER (PARTITION BY lang, term) AS first
        FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM shard GROUP BY ALL)
        QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}
        """,
    )
    return stage_table(found, "kept")


def shard_count(rows: DataFrame) -> int:
    """Shards for so many rows, and as many as the session shuffles into at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD_COUNTS + 1)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, p0), staged: a row a group with its sum of counts, that of its
    language, the language's number of kept terms, and what a term without occurrences weighs in the group."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    joined = groups.join(sums.drop("firsts"), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    return stage_table(joined.withColumn("p0", F.when(F.col("terms") > 0, weight(F.lit(0), F.col("total"), F.col("terms")))), "groups")


def weight(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)); the product is beyond 64 bits for large counts."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + 1)).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))


def _apart(p: str, q: str) -> str:
    """The divergence of two weights: both are at most 10^9 + 1, so their product has 64 bits."""
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


def _apart_spark(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group the other sources of its language (part pair)
    and the terms that it uses more than its language does (part term, the best `top`)."""
    kept = kept_terms(docs, least)
    groups = group_totals(docs, kept)
    weighed = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", weight(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", "lang_total", "terms")
    a, b = "x.p", "y.p"
    # The first query's sums are of terms that both have; the second's q is the language's.
    shards = _in_duckdb(
        weighed,
        shard_count(kept),
        "part string, lang string, source string, item string, value bigint",
        f"""
        SELECT 'pair' AS part, x.lang AS lang, x.source AS source, y.source AS item,
            sum({_apart(a, b)} - {_apart(a, "y.p0")} - {_apart("x.p0", b)} + {_apart("x.p0", "y.p0")})::BIGINT AS value
        FROM shard AS x JOIN shard AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY ALL
        """,
        f"""
        SELECT 'term' AS part, lang, source, term AS item, {_apart("p", "q")} AS value
        FROM (SELECT *, (1 + {SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1) // (lang_total + terms))::BIGINT AS q FROM shard)
        WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}
        """,
    )
    found = stage_table(shards, "parts")

    # What a source's own counts add, by how many of its terms have which count.
    x, y = (groups.select("lang", F.col("source").alias(own), F.col("total").alias(f"{own}_total"), F.col("terms").alias(f"{own}_terms"), F.col("p0").alias(f"{own}_p0")) for own in ("x", "y"))
    levels = kept.groupBy("lang", F.col("source").alias("own"), "n").agg(F.count("*").alias("times"))
    own = groups.select("lang", F.col("source").alias("own"), "p0", weight(F.lit(0), F.col("total"), F.col("terms")).alias("_"), "total", "terms").drop("_")
    at_level = levels.join(own, ["lang", "own"]).select("lang", "own", "times", "p0", weight(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    met = at_level.join(others, "lang").where("own <> other")
    as_first = met.groupBy("lang", F.col("own").alias("source"), F.col("other").alias("item")).agg(F.sum(F.col("times") * (_apart_spark("p", "q0") - _apart_spark("p0", "q0"))).alias("value"))
    as_second = met.groupBy("lang", F.col("other").alias("source"), F.col("own").alias("item")).agg(F.sum(F.col("times") * (_apart_spark("q0", "p") - _apart_spark("q0", "p0"))).alias("value"))
    pairs = x.join(y.drop("y_terms", "y_total"), "lang").where("x <> y")
    base = pairs.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), F.coalesce(F.col("x_terms") * _apart_spark("x_p0", "y_p0"), F.lit(0)).alias("value"))
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    summed = base.unionByName(as_first).unionByName(as_second).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        summed.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")),
        found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top),
    ]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")


OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
),
vocabulary AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY ALL),
counted AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
filled AS (
    SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + s.v))::BIGINT AS p
    FROM totals g JOIN vocabulary t USING (lang) JOIN sizes s USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
whole AS (
    SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(l.total) + any_value(v)))::BIGINT AS q
    FROM filled JOIN sizes USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL) l USING (lang) GROUP BY ALL
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM filled a JOIN filled b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
scored AS (
    SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT 'term', lang, source, term, (p - q) * (p - q) // q FROM filled JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM scored QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))
