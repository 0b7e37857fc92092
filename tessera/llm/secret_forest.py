"""Secret scan: candidates, and a random forest that removes false findings.

1. *Candidates*. Every value assigned to the name of a credential, whatever its length and
   characters (quoted values to the closing quote), and runs of at least 16 characters of
   ``[A-Za-z0-9+/_=-]`` inside words; with their position and the words around them.
2. *Features*, all column expressions: length; changes between character classes; shares of
   digits, capitals and hexadecimal digits; distinct characters; the part of the candidate that
   dictionary words cover; depth and words of the path (the source); the neighbouring words.
3. *Forest*. Spark's random forest is fitted on at most ``LABELLED`` labelled findings outside the
   held-out third and scores every candidate; findings under the threshold are removed.

Labelled findings are a table (doc_id, position, label), position being the candidate's word
number; the forest then sees all features. Without one, the findings that two rules decide are the labelled ones: assigned to a name of
a credential and varied (true), or digits only without such a name, mostly dictionary words, letters only outside an assignment, or with a whole
word for placeholders in or next to it (false); the others are scored only. Varied values are long, or have a
digit or sign besides letters, and are no expressions with brackets. These rules read the context, so the forest is
fitted without the features of it (``CONTEXT``): it learns the shape of values, path and neighbours, and finds
the values in running text that look like assigned ones. It decides alone, but for placeholders.

One narrow pass over the texts; only candidates are shuffled or written. Nothing runs in Python
on the executors.

Defined results: null and empty texts have no candidates; a value in several words has the position
of the first; the noncharacters U+FDD0 and U+FDD1 count as U+FFFD; a null source has depth 0;
without labelled findings of both kinds every score is 0.5; repeated rows give
repeated findings; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

LABELLED = 15_000
MIN_LENGTH = 16
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 6, 7

CANDIDATE = f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
#: fixed values: names of credentials, words of placeholders, dictionary of coverage, parts of paths
CREDENTIALS = "token|secret|passwd|password|passphrase|pwd|api_?key|apikey|access_?key|private_?key|auth|bearer|credential"
PLACEHOLDERS = "(?<![a-z0-9])(?:example|sample|dummy|placeholder|your|changeme|test|fake|x{4,}|redacted)(?![a-z0-9])"
DICTIONARY = ("the and for with that this from have not are was you all can has her his one our out use how new now name user data "
              "file test example sample value string number http https www com org net index page image path home time date key "
              "token secret password account version config default public private access session").split()
TEST_PATHS = "test|spec|example|sample|doc|fixture|mock"
CODE_PATHS = r"\\.(?:py|js|ts|java|go|rs|c|cc|h|rb|php|sh|ya?ml|json|toml|ini|env|conf|cfg|properties)$"

#: an assignment to a name of a credential: up to the value, its opening quote, the value (escaped, quoted in three ways, or bare)
OPEN, CLOSE = "\ufdd0", "\ufdd1"
ASSIGNMENT = (rf"(?i)((?:{CREDENTIALS})[a-z0-9_-]*+[\\\"'`\])]{{0,4}}[ \t]*+(?:=>|:=|={{1,3}}|:)(?:\s*+(?=\\?[\"'`])|[ \t]*+)(?:(?:bearer|basic|token)[ \t]++)?+)"
              r"(\\?(?:\"{3}|'{3}|[\"'`])|)"
              r"(?:(?<=\\[\"'`])([^\"'`\\\n]++)(?=\\[\"'`])|(?<=\")([^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+)(?=\")|(?<=')([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)(?=')"
              r"|(?<=`)([^`\n]*+)(?=`)|([^\s\"'`][^\s;,&]*+(?:[;,&](?!\w+[=:])[^\s;,&]*+)*+))")

FEATURES = ("length", "letter_digit", "digit_letter", "case_changes", "digits", "capitals", "hex", "distinct", "dictionary", "path_depth", "path_test",
            "path_code", "assigned", "credential", "quoted", "placeholder", "previous_length", "next_length")

#: what the rules read; left out where they label
CONTEXT = ("assigned", "credential", "quoted", "placeholder")


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, path, position, value, word and the neighbouring words of each candidate."""
    clean = F.translate(F.col(text).cast("string"), OPEN + CLOSE, "\ufffd\ufffd")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("path"),
                      F.regexp_replace(clean, ASSIGNMENT, f"$1$2{OPEN}$3$4$5$6$7{CLOSE}").alias("marked"))
    own = own.select("doc_id", "path", F.split("marked", OPEN).alias("pieces"), C.words(F.col("marked")).alias("marked"))
    own = own.withColumn("words", F.transform("marked", lambda w: F.translate(w, OPEN + CLOSE, "")))
    # the k-th opening mark begins the value at the head of piece k, in the word that holds the mark
    starts = F.flatten(F.transform("marked", lambda w, i: F.array_repeat(i, F.regexp_count(w, F.lit(OPEN)))))
    values = F.transform(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), lambda p, k: value_of(F.split_part(p, F.lit(CLOSE), F.lit(1)), F.get("pieces", k)))
    assigned = F.transform(F.arrays_zip(starts.alias("i"), values.alias("v")), lambda z: F.struct(z["i"].alias("position"), z["v"]["value"].alias("value"), z["v"]["quoted"].alias("quoted"), F.lit(True).alias("named")))
    runs = F.flatten(F.transform(F.filter(F.transform("marked", lambda w, i: F.when(w.rlike(f"[{OPEN}{CLOSE}]") | (F.char_length(w) >= MIN_LENGTH), i)), lambda i: i.isNotNull()), runs_of))
    own = own.withColumn("found", F.explode(F.concat(F.filter(assigned, lambda f: f["value"] != ""), runs)))
    at = lambda k: F.coalesce(F.get("words", F.col("found.position") + k), F.lit(""))
    return own.select("doc_id", "path", "found.*", at(0).alias("word"), at(-2).alias("before2"), at(-1).alias("before"), at(1).alias("after"), at(2).alias("after2"))


def value_of(value: Column, lead: Column) -> Column:
    """A value and whether it is quoted; a bare one without the signs that close what is around it."""
    quoted = lead.rlike("[\"'`]$")
    closing = F.when(value.rlike("[(\\[{<]"), F.regexp_replace(value, "[,;\"'`]+$", "")).otherwise(F.regexp_replace(value, "[)\\]}>,;\"'`]+$", ""))
    return F.struct(F.when(quoted, value).otherwise(closing).alias("value"), quoted.alias("quoted"))


def runs_of(i: Column) -> Column:
    """The runs of word i that are not an assigned value, alone or with its name."""
    marked, word = F.get("marked", i), F.get("words", i)
    own = F.regexp_extract_all(marked, F.lit(f"{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)), lambda r: ~F.exists(own, lambda v: (v == r) | ((v != "") & r.endswith(F.concat(F.lit("="), v)))))
    return F.transform(runs, lambda r: F.struct(i.alias("position"), r.alias("value"), word.rlike("^[\"'`]").alias("quoted"), F.lit(False).alias("named")))


def features(found: DataFrame) -> DataFrame:
    value, size = F.col("value"), F.char_length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    around = F.lower(F.concat_ws(" ", "before2", "before", "word", "value", "after", "after2"))
    lead = F.lower(F.concat_ws(" ", "before2", "before", F.split_part("word", F.col("value"), F.lit(1))))
    path = F.lower(F.coalesce("path", F.lit("")))
    named = {
        "length": size, "letter_digit": share("(?<=[A-Za-z])(?=[0-9])"), "digit_letter": share("(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "hex": share("[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / size, "dictionary": 1 - F.char_length(F.regexp_replace(F.lower("value"), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / size,
        "path_depth": F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit(""))), "path_test": path.rlike(TEST_PATHS), "path_code": path.rlike(CODE_PATHS.replace("\\\\", "\\")),
        "assigned": F.col("named") | lead.rlike("(?:[=:]|=>|:=)\\s*[\"'`]?\\s*$"), "credential": F.col("named") | lead.rlike(f"(?:{CREDENTIALS})"), "quoted": F.col("quoted"),
        "placeholder": around.rlike(PLACEHOLDERS), "previous_length": F.char_length("before"), "next_length": F.char_length("after"),
    }
    return found.select("doc_id", "position", "value", *[e.cast("double").alias(k) for k, e in named.items()])


def rule_label() -> Column:
    """1 or 0 where the rules decide, else null."""
    c = {k: F.col(k) for k in FEATURES}
    named = (c["credential"] == 1) & (c["assigned"] == 1)
    varied = ((c["length"] >= MIN_LENGTH) | F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[^A-Za-z\\s]")) & ~F.col("value").rlike("[(){}<>\\[\\]]")
    true = named & (c["placeholder"] == 0) & (c["digits"] < 1) & (c["dictionary"] < 0.5) & varied
    letters = ~named & (c["assigned"] == 0) & ~F.col("value").rlike("[^A-Za-z]")
    false = (c["digits"] == 1) & ~named | (c["dictionary"] >= 0.5) | (c["placeholder"] == 1) | letters
    return F.when(true, 1).when(false, 0)


def scan(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None, bound: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, position, length, value_sha256, held_out, score, kept of every candidate."""
    scratch = C.Scratch(spark, "secret-scan")
    found = features(candidates(docs)).withColumn("held_out", C.held_out(F.col("doc_id")))
    found = scratch.write(found, "candidates")
    if labelled is None:
        train = found.withColumn("label", rule_label())
    else:
        known = labelled.select("doc_id", "position", F.col("label").cast("int")).groupBy("doc_id", "position").agg(F.max("label").alias("label"))
        train = found.join(known, ["doc_id", "position"])
    train = train.where("label is not null and not held_out").select("label", "value", *FEATURES).dropDuplicates(["value"])
    train = scratch.write(train.orderBy(F.xxhash64("value"), "value").limit(bound), "train")
    kinds = train.agg(F.min("label").alias("least"), F.max("label").alias("most")).first()
    out = ["doc_id", "position", F.col("length").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "held_out"]
    if kinds["least"] == kinds["most"]:  # none, or of one kind
        return found.select(*out, F.lit(0.5).alias("score")).withColumn("kept", F.col("score") >= threshold)
    used = [f for f in FEATURES if labelled is not None or f not in CONTEXT]
    vector = VectorAssembler(inputCols=used, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(vector.transform(train))
    scored = model.transform(vector.transform(found)).withColumn("score", vector_to_array("probability")[1])
    allowed = F.lit(True) if labelled is not None else F.col("placeholder") == 0
    return scored.select(*out, "score", ((F.col("score") >= threshold) & allowed).alias("kept"))
