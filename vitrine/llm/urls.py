"""URL filter: allow and block rules by host and path, and logistic regression for the rest, in DataFrame operations only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
#: Tasks that the fit deals its rows to.
FIT_TASKS = 4
#: The labelled table: words of unwanted and of ordinary sites, and words that go before or after either; names are made by rule.
UNWANTED = tuple(
    "casino poker slots roulette blackjack jackpot betting bookmaker gambling lottery bingo wager sportsbook "
    "viagra cialis levitra pills pharmacy meds tramadol xanax steroids dietpill painkiller "
    "porn xxx sex adult escort webcam nude hentai hookup fetish camgirl "
    "payday loan cash forex doubler debtrelief creditfix getrich profit binaryoption "
    "replica rolex handbag counterfeit knockoff outlet sneaker designer "
    "torrent warez keygen serialkey nulled cracked pirate moviez "
    "adserver banner popunder tracker clickbait adnetwork adtracking pixel doorway backlink "
    "spam spammer bulkmail followers autosurf linkfarm emailblast robocall "
    "prize winner giveaway giftcard freegift survey verifyaccount phishing virusalert scareware".split()
)
ORDINARY = tuple(
    "library weather garden history recipes museum science journal theatre cycling school research council news sports music archive university observatory botany "
    "gazette herald chronicle evening tribune parliament ministry statistics health hospital clinic dentist veterinary firebrigade police court "
    "bakery butcher restaurant coffee brewery vineyard farm market orchard dairy hotel campsite travel railway airport ferries timetable maps tourism hiking sailing rowing "
    "football tennis swimming athletics chess gymnastics volleyball rugby badminton climbing skiing photography painting sculpture gallery orchestra choir opera cinema film literature poetry "
    "bookshop publisher dictionary encyclopedia grammar translation linguistics philosophy theology cathedral parish monastery heritage archaeology genealogy geology chemistry physics biology astronomy mathematics "
    "engineering carpentry plumbing electrician architecture construction beekeeping forestry fishing birdwatch wildlife nature climate oceanography software kernel compiler docs database "
    "network developer tutorial press kindergarten primary college alumni scholarship volunteers charity redcross foundation community neighbourhood townhall "
    "insurance bank accountant notary law consumer recycling waterworks energy solar bicycle repair furniture ceramics knitting sewing quilts toys puzzles boardgames aquarium planetarium zoo".split()
)
AROUND_UNWANTED = tuple("best buy cheap free get hot live mega my new online pro quick real super top vip win deals hub king land now palace shop site store world zone discount".split())
AROUND_ORDINARY = tuple("the my new old city royal national north green blue first open online best top live free real super club hub house land world center group shop store site zone".split())
#: Parts of invented names, which ordinary sites often have.
ONSETS, VOWELS, CODAS = ("b", "br", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "tr", "v", "w"), ("a", "e", "i", "o", "u", "ai", "ea", "io"), ("", "l", "n", "r", "s", "x", "nt", "nd")
INVENTED, COMBINATIONS = 500, 6
#: What stands before the name, after it, and the path: dealt to all names alike, so that they tell nothing of the label.
FRONTS = ("", "www.", "blog.", "m.", "shop.", "en.", "static.")
DOMAINS = ("com", "net", "org", "info", "co.uk", "de", "example.com", "example.net", "example.org", "fr", "eu")
PATHS = ("/", "", "/index.html", "/en/12", "/fr/345.html", "/de/67", "/es/890/", "/en/401", "/2021/05/post-17", "/about", "/articles/a-short-title", "/p/93", "/category/page/2/")
SHAPES_EACH = 5
#: Unwanted ones among all URLs, as assumed for the constant.
BLOCKED_SHARE = 0.4


def combined(words: tuple[str, ...], around: tuple[str, ...]) -> list[tuple[str, str]]:
    """(word, name): each word alone and with COMBINATIONS others before or after it, with a dash or without."""
    out = []
    for n, word in enumerate(words):
        out.append((word, word))
        for k in range(COMBINATIONS):
            other = around[(7 * n + 5 * k + n // len(around)) % len(around)]
            dash = "-" if (n + k) % 3 else ""
            out.append((word, f"{other}{dash}{word}" if (n + k) % 2 else f"{word}{dash}{other}"))
    return out


def invented(count: int) -> list[tuple[str, str]]:
    """(name, name): names of two or three syllables, in a fixed order."""
    out = []
    for n in range(count):
        syllables = (ONSETS[(n * 11 + k * 5 + n // 7) % len(ONSETS)] + VOWELS[(n * 3 + k * 7 + n // 5) % len(VOWELS)] + CODAS[(n * 5 + k * 3 + n // 11) % len(CODAS)] for k in range(2 + n % 2))
        name = "".join(syllables)
        out.append((name, name))
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, each marked with its part."""

    def of(text: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, n))) for n in GRAMS]

    return F.array_distinct(F.concat(*of(host, "h"), *of(path, "p")))


def labelled_names() -> list[tuple[str, str, float]]:
    """(word, name, blocked) of the built-in table."""
    return [(w, n, 1.0) for w, n in combined(UNWANTED, AROUND_UNWANTED)] + [(w, n, 0.0) for w, n in combined(ORDINARY, AROUND_ORDINARY) + invented(INVENTED)]


def labelled_urls(spark: SparkSession, names: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(url, blocked): the built-in training table, or one of the given names."""
    rows = []
    for n, (_, name, label) in enumerate(names or labelled_names()):
        for k in range(SHAPES_EACH):
            front, domain, path = FRONTS[(5 * k + n) % len(FRONTS)], DOMAINS[(3 * k + n // 7) % len(DOMAINS)], PATHS[(2 * k + n // 3) % len(PATHS)]
            rows.append(f"{int(label)}https://{front}{name}.{domain}{path}")
    row = F.explode(F.split(F.lit(" ".join(rows)), " "))
    return spark.range(1).select(row.alias("row")).select(F.substring("row", 2, 1000).alias("url"), F.substring("row", 1, 1).cast("double").alias("blocked"))


def fit(labelled: DataFrame, penalty: float = 0.00001) -> PipelineModel:
    """Logistic regression on the hashed n-grams of a small labelled table (url, blocked); both classes weigh the same."""
    shares = F.broadcast(labelled.groupBy("blocked").agg((F.lit(1.0) / F.count("*")).alias("weight")))
    rows = labelled.join(shares, "blocked").repartition(FIT_TASKS).select(F.col("blocked").alias("label"), "weight", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("__grams")).cache()
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features")
    regression = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="weight", regParam=penalty, standardization=False, maxIter=25, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")
    model = Pipeline(stages=[hashed, regression]).fit(rows)
    rows.unpersist()
    return model


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule (verdict, host, path), else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: PipelineModel, url_col: str = "url", blocked_share: float = BLOCKED_SHARE) -> DataFrame:
    """All rows and columns with host, path, rule, verdict (allow or block) and block_score (the method's, 0 to 1).

    The longest fitting rule decides, else the score from 0.5 on blocks; the score is the regression's at
    `blocked_share`, the share of unwanted ones among the URLs to be judged. A null url or one without :// has
    empty host and path and is judged by them. Repeated rows stay; an empty table gives no rows; input columns
    of these names are replaced, others of any name are kept.
    """
    made = ("host", "path", "rule", "verdict", "block_score")
    kept = [c for c in pages.columns if c not in made]
    url = F.col(url_col)
    rows = pages.select(F.struct(*kept).alias("__row"), host_of(url).alias("__host"), path_of(url).alias("__path"))
    scored = model.transform(rows.withColumn("__grams", grams(F.col("__host"), F.col("__path"))))
    p, odds = vector_to_array(F.col("__probability"))[1], blocked_share / (1 - blocked_share)
    found = scored.select("__row", F.col("__host").alias("host"), F.col("__path").alias("path"), rule_of(F.col("__host"), F.col("__path"), rules).alias("__rule"), (p * odds / (p * odds + (1 - p))).alias("block_score"))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return found.select("__row.*", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "block_score")
