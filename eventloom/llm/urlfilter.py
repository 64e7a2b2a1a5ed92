"""URL filters: host and path rules, and logistic regression on hashed character n-grams for all other URLs.

Only SQL functions and Spark's own feature and regression stages run on the pages: host and path are cut out, every suffix of
the host is looked up among the rules, and hashed n-grams are weighed by a model that is trained from a small labelled URL table.

Rows: a null URL or one without :// has an empty host and path, matches no rule and is judged by the method, which allows it
(its score is 0, as no n-gram speaks against it); repeated rows and ids stay; extra columns are dropped;
an empty table gives an empty result. Of rules of one length the one that sorts last wins.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, GRAM, STEPS, DECAY = 1024, 3, 40, 1e-3

#: The rules of the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: The default labelled table is made from these ordinary words, written down for this library without regard to any crawl:
#: what names of unwanted and of wanted sites are commonly made of. A real table is an argument of judge().
UNWANTED = (
    "casino poker roulette jackpot slots betting bets lottery gambling bingo pills pharmacy viagra cialis steroids diet weightloss miracle "
    "porn adult xxx escort webcam dating hookup loans payday credit debt forex crypto bonus prize winner win free cheap discount replica "
    "rolex warez torrent crack keygen serial spam ads adserver banner popup track tracker tracking click clicks bait traffic seo backlinks farm malware phish"
).split()
WANTED = (
    "library museum university college school academy institute archive gazette journal magazine news times post press weather science history "
    "nature garden recipes kitchen cooking travel guide maps railway city council parliament court hospital clinic health church theatre opera "
    "music orchestra cinema books reader writer poetry language dictionary encyclopedia software developer forum notes diary blog photo art sport club "
    "football chess hiking family kids community village market bakery workshop craft energy water forest river mountain"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default training table (url, unwanted): one URL for each of a fixed number of pairs of words, by rule."""
    rows = []
    for bad, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(words):
            for j in range(4):
                other = words[(i * 7 + j * 13 + 1) % len(words)]
                name = (word, f"{word}-{other}", f"{word}{other}", f"{other}-{word}")[j]
                top, sub = ("com", "net", "org", "info")[(i + j) % 4], ("", "www.", "m.", "")[(i // 4 + j) % 4]
                path = ("/", f"/{other}", f"/en/{(i * 131 + j * 37) % 1000}", f"/{word}.html")[(i // 2 + j) % 4]
                rows.append((f"http{'s' * ((i + j) % 2)}://{sub}{name}.{top}{path}", bad))
    return spark.createDataFrame(rows, "url string, unwanted int")


def host_of(url: Column) -> Column:
    """From :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of a URL; host and path have their own."""

    def of(mark: str, text: Column) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(whole) - (GRAM - 1), F.lit(1)))
        return F.when(F.length(text) > 0, F.transform(at, lambda i: F.concat(F.lit(mark), whole.substr(i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))

    return F.concat(of("h", host), of("p", path))


def train(labelled: DataFrame) -> Transformer | None:
    """Hashing of n-grams to SLOTS slots, scaling to length one and logistic regression, fitted by L-BFGS on (url, unwanted);
    None without a labelled URL."""
    cut = labelled.select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), F.col("unwanted").cast("double").alias("unwanted"))
    rows = cut.where("unwanted is not null and size(grams) > 0").coalesce(1)  # the table is small by contract
    if rows.isEmpty():
        return None
    hashed = HashingTF(inputCol="grams", outputCol="hashed", numFeatures=SLOTS, binary=True)
    scaled = Normalizer(inputCol="hashed", outputCol="features")
    regression = LogisticRegression(labelCol="unwanted", maxIter=STEPS, regParam=DECAY, standardization=False)
    return Pipeline(stages=[hashed, scaled, regression]).fit(rows)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, action) of the longest rule that fits, null if none does. The rules are an argument, so small."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,action:string,path:string>")
    by_host: dict[str, list[Column]] = {}
    for action, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append(F.struct(F.lit(len(rule_host + rule_path)).alias("length"), F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"), F.lit(rule_path).alias("path")))
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(listed, lambda r: path.startswith(r["path"])))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): the longest rule's verdict, else that of the regression."""
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    url = F.col(f"`{url_col}`").cast("string")
    cut = pages.select(F.col(f"`{id_col}`").alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    found = cut.withColumn("best", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("grams", grams(F.col("host"), F.col("path")))
    scored = model.transform(found) if model else found.withColumn("grams", F.array().cast("array<string>"))
    score = vector_to_array("probability")[1] if model else F.lit(0.0)
    judged = scored.withColumn("score", F.when(F.size("grams") > 0, score).otherwise(F.lit(0.0)))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "score")
