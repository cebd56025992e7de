"""Token counts kept up to date by deltas.

A change carries what a document counted before and what it counts after: an insert has no before, a delete no after, a
revision (new text, source, language or tokenizer version) both. Each side is a signed row, and a batch is the sum of its
signed rows by source, language and tokenizer version. Totals are the sums over the committed batches.

A batch is committed by Spark's own write of its folder ``batch=<id>``: it counts once its success file is there. To commit
a batch again changes nothing; what a lost driver left unfinished is overwritten. Changes of one id in a batch count once.

Edge cases: null texts have no tokens but count as documents; null sources and languages are groups of their own; a group
whose documents and tokens are both back at nothing is left out; a store without batches has no totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.session import scratch_path

from .common import materialize, table

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
SIDE = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"
SPACE = r" \t\n\x0B\f\r"
#: Tokenizer versions: what one token is.
TOKENIZERS = {"words-1": rf"[^{SPACE}]+", "pieces-1": rf"[A-Za-z]+|[0-9]+|[^A-Za-z0-9{SPACE}]"}


def count_tokens(text: Column | str, tokenizer: str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("bigint")


def side(tokenizer: str, n_tokens: Column | str, source: str = "source", lang: str = "lang") -> Column:
    """What a document counts: one side of a change."""
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    return F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(tokenizer).alias("tokenizer"), n.cast("bigint").alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (change_id, before, after) by ``GROUP``: summed in each task before the shuffle."""
    once = changes.select("change_id", "before", "after").dropDuplicates(["change_id"])
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("side")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("side")))
    rows = once.select(F.explode(signed).alias("r")).filter("r.side is not null").select("r.sign", "r.side.*")
    tokens = F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0)))
    sums = rows.groupBy(*GROUP).agg(F.sum("sign").cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"))
    return sums.filter("n_docs != 0 or n_tokens != 0")


class Rollup:
    """A store of committed batches under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def committed(self) -> list[str]:
        """Names of the folders of committed batches."""
        fs, place = self._files(self.path)
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(self._files(f"{self.path}/{n}/_SUCCESS")[1]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was there already."""
        if f"batch={batch}" in self.committed():
            return False
        deltas(changes).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        paths = [f"{self.path}/{n}" for n in self.committed()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 or n_tokens != 0")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, English is counted anew by pieces, short documents are deleted.

    The second batch is committed twice, as after a lost answer.
    """
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", "lang", "n_chars", *[count_tokens("text", t).alias(t) for t in TOKENIZERS])
    # documents may repeat an id, so a change is named by its row
    counted = materialize(counted.withColumn("row", F.monotonically_increasing_id()), "counted")
    words, pieces, none = side("words-1", "`words-1`"), side("pieces-1", "`pieces-1`"), F.lit(None).cast(SIDE)
    english = F.col("lang").eqNullSafe("en")
    change = lambda rows, before, after: rows.select(F.col("row").alias("change_id"), before.alias("before"), after.alias("after"))
    store = Rollup(spark, scratch_path(spark, "token-counts"))
    store.commit("1", change(counted, none, words))
    for _ in range(2):
        store.commit("2", change(counted.filter(english), words, pieces))
    store.commit("3", change(counted.filter("n_chars < 200"), F.when(english, pieces).otherwise(words), none))
    return store.totals()


SQL = """
WITH c AS (
  SELECT source, lang, CASE WHEN lang = 'en' THEN 'pieces-1' ELSE 'words-1' END AS tokenizer,
    CASE WHEN lang = 'en' THEN len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \\t\\n\\x0B\\f\\r]'))
         ELSE len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) END AS n
  FROM documents WHERE NOT coalesce(n_chars < 200, false))
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang, tokenizer
"""
