"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is its words with their counts as weights. For a sample and a term k of weight S, r and c are Gamma(2, 1) and b is
uniform, all drawn from the hash of (k, sample); t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The
sample is the term of the least a together with its t, and two texts have the same one with the probability of their
generalised Jaccard similarity (sum of least weights over sum of largest). As a is a function of k and t, the least value
of ln a stands for both, so that a sample is a ``min``.

Each of the ``SAMPLES`` samples is drawn over all terms of a text, so that the likeness, the share of equal samples, has the
generalised Jaccard similarity as its expected value, however unlike the weights are. What is drawn for a term serves all
versions of a text; only t and a depend on the weight.

Texts move once: rows are dealt into blocks of neighbouring ids, and the words of a text are counted where it lies.

Edge cases: null text is empty; texts without words have a fingerprint of empty places, are like each other and unlike all
others. The next document goes by descending id, ids equal by descending text, rows without id last; the last row is
followed by the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLES = 32
BLOCK_BYTES = 64 << 20
MOST_BLOCKS = 10_000
COARSE = 64
_UNIT = float(1 << 24)


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 24) - 1)) + F.lit(0.5)) / F.lit(_UNIT)


def log_sample(term: Column, log_weight: Column, sample: int) -> Column:
    """ln a of a term (a hash) for a sample."""
    h1, h2 = (F.xxhash64(term, F.lit(2 * sample + i)) for i in range(2))
    r = -F.ln(_uniform(h1, 0) * _uniform(h1, 24))
    c = -F.ln(_uniform(h2, 0) * _uniform(h2, 24))
    # the bits that the others leave
    b = _uniform(F.shiftrightunsigned(h1, 48).bitwiseXOR(F.shiftleft(F.shiftrightunsigned(h2, 48), 8)), 0)
    t = F.floor(log_weight / r + b)
    return F.ln(c) - r * (t - b) - r


def signatures(texts: DataFrame, keys: list[str], text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(keys, signature): SAMPLES values for each text, null for one without words; rows without any word are left out.

    ``others`` are columns with other versions of the text, their signatures named by the column. ``texts`` should be
    partitioned by some of ``keys``; then nothing is shuffled here. ``keys`` tell texts apart.
    """
    columns = [text, *others]
    versions = F.array(*[F.struct(F.lit(v).alias("v"), F.col(c).alias("t")) for v, c in enumerate(columns)])
    texts = texts.select(*keys, F.inline(versions))
    words = texts.select(*keys, "v", F.explode(F.split(F.lower("t"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word != ''")
    counts = [F.count_if(F.col("v") == v).alias(f"n{v}") for v in range(len(columns))]
    terms = words.select(*keys, "v", F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(*counts)
    # the logarithm of 0 is null, so that a version has no sample of a term it lacks
    terms = terms.select(*keys, "term", *[F.ln(f"n{v}").alias(f"w{v}") for v in range(len(columns))])
    least = [F.min(log_sample(F.col("term"), F.col(f"w{v}"), i)).alias(f"m{v}_{i}") for v in range(len(columns)) for i in range(SAMPLES)]
    value = lambda m: F.xxhash64(m).bitwiseAND(F.lit(0xFFFFFFFF))
    values = lambda v: F.when(F.col(f"m{v}_0").isNotNull(), F.array(*[value(f"m{v}_{i}") for i in range(SAMPLES)]))
    names = ["signature", *others]
    return terms.groupBy(*keys).agg(*least).select(*keys, *[values(v).alias(n) for v, n in enumerate(names)])


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal values; null signatures are those of texts without words."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(SAMPLES))


def fingerprint(signature: Column | str) -> Column:
    """Eight hexadecimal digits for each value, dashes for a text without words."""
    one = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.coalesce(F.array_join(F.transform(signature, one), ""), F.lit("-" * 8 * SAMPLES))


def _blocks(docs: DataFrame) -> Column:
    """The number of a row's block: ids in order, blocks of like size, rows without id in -1."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = min(MOST_BLOCKS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    fine = [cuts[i : i + COARSE] for i in range(0, len(cuts), COARSE)] or [[]]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))


    def numbers(values: list[int]) -> Column:
        """A literal array in one expression, however long."""
        text = F.split(F.lit(",".join(map(str, values))), ",") if values else F.array()
        return text.cast("array<bigint>")

    coarse = below(numbers([f[0] for f in fine[1:]]))
    table = F.array(*map(numbers, fine))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(coarse * COARSE + below(F.element_at(table, coarse + 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with their block and rank in it, and of the next document its block, rank and text."""
    rows = docs.withColumn("block", _blocks(docs))
    order = [F.desc_nulls_last("doc_id"), F.desc("text")]
    within = Window.partitionBy("block").orderBy(*order)
    ranked = rows.withColumns({"rank": F.row_number().over(within), "next_text": F.lead("text").over(within)})
    # the first row of each block follows the last of the block before: a row a block
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top"))
    heads = rows.alias("r").join(F.broadcast(tops).alias("t"), (F.col("r.block") == F.col("t.block")) & F.col("r.doc_id").eqNullSafe(F.col("t.top")))
    heads = heads.groupBy("r.block").agg(F.max("r.text").alias("head"))
    across = Window.orderBy(F.desc("block"))
    first = F.first(F.struct("block", "head")).over(across)
    following = heads.select("block", F.coalesce(F.lead(F.struct("block", "head")).over(across), first).alias("following"))
    following = materialize(following, "heads")
    joined = ranked.join(following, "block", "left")
    last = F.col("next_text").isNull()
    return joined.select(
        "doc_id", "text", "block", "rank",
        F.when(last, F.col("following.block")).otherwise(F.col("block")).alias("next_block"),
        F.when(last, 1).otherwise(F.col("rank") + 1).alias("next_rank"),
        F.when(last, F.col("following.head")).otherwise(F.col("next_text")).alias("next_text"),
    )


def edited(text: str, other: str) -> Column:
    """``text`` with its last third replaced by as many first code points of ``other``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("edited", edited("text", "next_text"))
    n_chars, digest = F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    facts = materialize(rows.select("doc_id", "block", "rank", "next_block", "next_rank", n_chars, digest), "facts")
    found = materialize(signatures(rows, ["block", "rank"], "text", ("edited",)), "signatures")
    own = found.select("block", "rank", F.col("signature").alias("own"), F.col("edited").alias("changed"))
    after = own.select(F.col("block").alias("next_block"), F.col("rank").alias("next_rank"), F.col("own").alias("next"))
    sides = [(own, ["block", "rank"]), (after, ["next_block", "next_rank"])]
    joined = reduce(lambda d, x: d.join(x[0], x[1], "left"), sides, facts)
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
