"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame and SQL expressions and Spark ML on the JVM; there is no Python on the executors.
The model is trained from a small labelled URL table, a parameter; the default one, of whole URLs, is in url_labels.py, and
one in `HELD_OUT` of it is kept out of training, to measure by.

Defined results: a null url, or one without "://", has the host "" and the path ""; no rule fits it and the model
judges it by its intercept.  Repeated rows are judged alike and kept.  An empty input gives an empty result.
Further columns of the input pass through `judge_urls`, whatever their names, unless they bear one it adds, which it
replaces.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import ascii_lower, others, quoted, spark_of, unused
from stratalog.llm.url_labels import ALLOW, BLOCK

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Of the default table, one url in so many is held out of training.
HELD_OUT = 5


def default_labels(spark: SparkSession) -> DataFrame:
    """The small labelled URL table (url, label; 1 is to be blocked; held_out, by the crc32 of the url)."""
    rows = [F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for label, urls in ((1.0, BLOCK), (0.0, ALLOW)) for url in urls]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumn("held_out", F.crc32("url") % HELD_OUT == 0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to /, ?, # or the end, A-Z lower-cased.  Path: from there up to ?, # or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent domain of it and whose path begins the url's, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    edged = F.concat(F.lit("^"), text, F.lit("$"))
    def pieces(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(edged) - n + 1)
        cut = F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(edged, i, F.lit(n))))
        return F.when(F.length(edged) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(pieces, sizes))


def _grams_of(host: Column, path: Column, sizes: tuple[int, ...]) -> Column:
    """N-grams of host and path.  Paths lose their digits, which say nothing of the site."""
    return F.concat(_grams(host, "h", sizes), _grams(F.regexp_replace(path, "[0-9]+", "0"), "p", sizes))


def train(labelled: DataFrame, *, sizes: tuple[int, ...] = (2, 3, 4), width: int = 1 << 13, penalty: float = 0.05, prefix: str = "_") -> PipelineModel:
    """Logistic regression from a labelled URL table (url, label), which should be small: it is read once a step."""
    host, path = host_and_path(F.col("url"))
    label = F.col("label").cast("double")
    share = labelled.agg(F.avg(label)).first()[0] or 0.0  # both classes weigh alike
    rows = labelled.select(_grams_of(host, path, sizes).alias(f"{prefix}grams"), label.alias("label"), (F.when(label == 1, F.lit(1 - share)).otherwise(F.lit(share)) if 0 < share < 1 else F.lit(1.0)).alias("weight"))
    hashed = HashingTF(numFeatures=width, binary=True, inputCol=f"{prefix}grams", outputCol=f"{prefix}hashed")
    return Pipeline(stages=[hashed, LogisticRegression(featuresCol=f"{prefix}hashed", weightCol="weight", regParam=penalty, probabilityCol=f"{prefix}p", rawPredictionCol=f"{prefix}raw", predictionCol=f"{prefix}said")]).fit(rows)


def judge_urls(pages: DataFrame, *, url: str = "url", rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and p_block, the model's probability of block."""
    known = labelled if labelled is not None else default_labels(spark_of(pages)).where("not held_out")
    # The model's columns get a prefix that no column of pages begins with.
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in pages.columns):
        prefix += "_"
    model = train(known, sizes=sizes, prefix=prefix)
    columns = others(pages, "host", "path", "rule", "verdict", "p_block")
    host_, path_ = unused(pages, f"{prefix}host", f"{prefix}path")
    host, path = host_and_path(quoted(url))
    parsed = pages.select(*map(quoted, columns), host.alias(host_), path.alias(path_))
    featured = parsed.withColumn(f"{prefix}grams", _grams_of(F.col(host_), F.col(path_), sizes))
    rule, verdict = matching_rule(F.col(host_), F.col(path_), rules)
    p = vector_to_array(f"{prefix}p").getItem(1)
    said = F.when(p >= threshold, "block").otherwise("allow")
    return model.transform(featured).select(*map(quoted, columns), F.col(host_).alias("host"), F.col(path_).alias("path"), rule.alias("rule"), F.coalesce(verdict, said).alias("verdict"), p.alias("p_block"))
