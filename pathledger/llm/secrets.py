"""Secret scans: candidates by shape, false positives removed by a random forest.

Built-in functions and Spark's own forest only.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from pathledger.session import materialise

# One kind of candidate is a run of these characters in a word, this long or longer, with a digit in it.
LEAST = 16
_RUN = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
_NAMES = "(?i)(pass|pwd|secret|token|api.?key|access|auth|credential|private)"
_KNOWN = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^sk_(live|test)_|^glpat-"
# The other kind is a value of 8 characters or more given to one of these names, quoted or not of letters alone.
_GIVEN_NAMES = "(?i)(password|passwd|pwd|secret|token|api.?key|credential|(private|access|auth).?key)[\\w\\]\"')-]*"
_GIVEN_HERE = f"{_GIVEN_NAMES}[=:]"
_GIVEN_BEFORE = f"{_GIVEN_NAMES} ?[=:]+$"
_GIVEN = "^((?>(?:[^=:]*[=:]++(?=.))?)[\"'(\\[{]*)(?!//)([^\"']{8,}?)(?:[)\\]},;.]*|[\"'].*)$"
# A word counts as a dictionary word if this share of the distinct texts has it, whatever their number.
DICTIONARY_SHARE = 0.001
MAX_LABELLED = 20_000

FEATURES = (
    "length", "runs", "digits", "upper", "distinct", "hexadecimal", "known_format", "coverage",
    "assigned", "quoted", "named_here", "named_before", "named_after", "path_depth", "path_sample",
)


def _words(text):
    return F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")


def candidates(docs: DataFrame, doc_id="doc_id", text="text", path="source") -> DataFrame:
    """(doc_id, path, word_no, before2, before, after, value, head) of all runs that may be a secret.

    ``word_no`` counts the words of the text from 0. Each run of a word with a digit in it counts,
    repeats too; ``head`` is what stands before it in the word, from the candidate before on if
    there is one. A word without such runs has one where it gives a value to a name such as token, in the word itself
    or in the two before: shorter values and those of letters alone, the latter in quotes. Null and empty texts have none; neighbours beyond an end of the text are ''.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), _words(F.col(text)).alias("words"))

    def suspicious(w):
        return (F.length(w) >= LEAST) & w.rlike(_RUN) & w.rlike("[0-9]")

    def given(word, before2, before):
        """Whether the word holds a value given to a name, in it or in the two words before."""
        value, head = F.regexp_extract(word, _GIVEN, 2), F.regexp_extract(word, _GIVEN, 1)
        # Letters alone are a value only in quotes; a word that itself ends in a sign names the next one.
        shaped = (F.length(value) >= 8) & (~value.rlike("^[A-Za-z]*[=:]*$") | head.rlike("[\"']$"))
        return shaped & (head.rlike(_GIVEN_HERE) | F.concat_ws(" ", before2, before).rlike(_GIVEN_BEFORE))

    def given_at(i):
        return given(*[F.get("words", i + k) for k in (0, -2, -1)])

    # Most texts have none, and are done after this one look at their words.
    words = words.filter(F.exists("words", lambda w: suspicious(w) | w.rlike(_GIVEN_NAMES)))
    every = F.sequence(F.lit(0), F.size("words") - 1)
    places = F.filter(every, lambda i: suspicious(F.get("words", i)) | given_at(i))
    near = {"word": 0, "before2": -2, "before": -1, "after": 1}
    found = words.select("doc_id", "path", "words", F.explode(places).alias("word_no"))
    sides = [F.coalesce(F.get("words", F.col("word_no") + k), F.lit("")).alias(n) for n, k in near.items()]
    found = found.select("doc_id", "path", "word_no", *sides)
    # A word is a gap, a run, a gap and so on.
    found = found.withColumn("runs", F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)))
    found = found.withColumn("gaps", F.split("word", _RUN, -1))
    digits = F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda i: F.get("runs", i).rlike("[0-9]"))
    found = found.withColumn("own", F.when(F.size("runs") > 0, digits).otherwise(F.array().cast("array<int>")))
    parts = F.flatten(F.transform("gaps", lambda gap, i: F.array(gap, F.coalesce(F.get("runs", i), F.lit("")))))
    found = found.withColumn("parts", parts)

    def candidate(i, at):
        last = F.when(at > 0, F.get("own", at - 1))
        start = F.coalesce(2 * last + 2, F.lit(1))
        head = F.array_join(F.slice("parts", start, 2 * i + 2 - start), "")
        return F.struct(F.get("runs", i).alias("value"), head.alias("head"))

    # Words without a run of the first kind are here for the value that they give.
    value, head = (F.regexp_extract("word", _GIVEN, k) for k in (2, 1))
    whole = F.array(F.struct(value.alias("value"), head.alias("head")))
    own = F.when(F.size("own") > 0, F.transform("own", candidate)).otherwise(F.when(given("word", "before2", "before"), whole))
    found = found.withColumn("one", F.explode(own))
    return found.select("doc_id", "path", "word_no", "before2", "before", "after", "one.value", "one.head")


def _chunks(value):
    return F.regexp_extract_all(F.lower(value), F.lit("([a-z]{3,})"), F.lit(1))


def dictionary(docs: DataFrame, found: DataFrame, text="text") -> DataFrame:
    """(chunk, share): in what share of the distinct texts the letter runs of the candidates are words of their own.

    All documents are read, and copies count once, so twice the corpus gives the same dictionary. The numbers
    of texts are HyperLogLog estimates (5 %), which combine before the shuffle; only words that some
    candidate contains get that far.
    """
    chunks = materialise(found.select(F.explode(_chunks(F.col("value"))).alias("chunk")).distinct(), "chunks")
    content = F.xxhash64(F.col(text)).alias("content")
    texts = docs.select(content).agg(F.approx_count_distinct("content")).first()[0]
    words = docs.select(content, F.explode(_words(F.col(text))).alias("word")).filter(F.length("word") >= 3)
    # A word with digits at its ends is no word, else a value would stand for its own letters.
    words = words.select("content", F.lower(F.regexp_replace("word", "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")).alias("chunk"))
    share = F.approx_count_distinct("content") / F.lit(max(1, texts))
    return words.join(chunks, "chunk").groupBy("chunk").agg(share.alias("share"))


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the FEATURES of each candidate, all doubles. ``known``: see ``dictionary``."""
    value = F.col("value")
    good = known.filter(F.col("share") >= DICTIONARY_SHARE).select("chunk")
    # Per distinct value: the letters that stand in dictionary words.
    parts = found.select("value", F.explode(F.array_distinct(_chunks(value))).alias("chunk"))
    parts = parts.distinct().join(good, "chunk")
    covered = parts.groupBy("value").agg(F.sum(F.length("chunk")).alias("covered"))
    kinds = value
    for pattern, mark in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^aA0]", "-")):
        kinds = F.regexp_replace(kinds, pattern, mark)
    length = F.length("value")
    head = F.col("head")
    path = F.coalesce("path", F.lit(""))
    columns = {
        "length": length,
        # Runs of one kind of character are one more than the transitions between kinds.
        "runs": F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")) / length,
        "digits": F.regexp_count("value", F.lit("[0-9]")) / length,
        "upper": F.regexp_count("value", F.lit("[A-Z]")) / length,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.least(length, F.lit(36)),
        "hexadecimal": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & value.rlike("[A-Fa-f]"),
        "known_format": value.rlike(_KNOWN),
        "coverage": F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / length),
        "assigned": head.rlike("[=:]") | F.col("before").rlike("[=:]$"),
        "quoted": head.rlike("[\"']$"),
        "named_here": head.rlike(_NAMES),
        "named_before": F.concat_ws(" ", "before2", "before").rlike(_NAMES),
        "named_after": F.col("after").rlike(_NAMES),
        "path_depth": F.regexp_count(path, F.lit("/")),
        "path_sample": path.rlike("(?i)test|example|sample|fixture|docs?/"),
    }
    joined = found.join(covered, "value", "left")
    return joined.select(*found.columns, *[columns[c].cast("double").alias(c) for c in FEATURES])


def rule_labels(rows: DataFrame) -> DataFrame:
    """Candidates with ``label`` where rules of high precision tell it; stands in for reviewed findings.

    1: a known format, or a hexadecimal or mixed value assigned to a name such as token or
    password. 0: neither assigned nor named, and digits alone, or half of it dictionary words.
    """
    named = (F.col("named_here") == 1) | (F.col("named_before") == 1)
    mixed = (F.col("digits") < 1) & (F.col("coverage") < 0.5)
    yes = (F.col("known_format") == 1) | ((F.col("assigned") == 1) & named & mixed)
    no = (F.col("assigned") == 0) & ~named & ((F.col("digits") == 1) | (F.col("coverage") >= 0.5))
    return rows.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).filter("label is not null")


def remove_false_positives(rows: DataFrame, labelled: DataFrame, threshold=0.5, max_rows=MAX_LABELLED) -> DataFrame:
    """``rows`` with the forest's ``probability`` of a secret and ``secret``.

    ``labelled`` has FEATURES and ``label`` (0 or 1); the forest is fitted on ``max_rows`` of it at
    most, those with the smallest hashes. With labels of one kind alone there is nothing to
    tell apart: every candidate gets that label; without labels all are reported.
    """
    sample = labelled.select(*FEATURES, "label").orderBy(F.xxhash64(*FEATURES), "label").limit(max_rows)
    sample = materialise(sample, "labelled")
    kinds = sorted(row.label for row in sample.select("label").distinct().collect())  # two at most
    if len(kinds) < 2:
        scored = rows.withColumn("probability", F.lit(kinds[0] if kinds else 1.0))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=24, maxDepth=6, seed=7)
        model = forest.fit(vectors.transform(sample))
        scored = model.transform(vectors.transform(rows))
        scored = scored.withColumn("p", vector_to_array("probability")[1])
        scored = scored.select(*rows.columns, F.col("p").alias("probability"))
    return scored.withColumn("secret", F.col("probability") >= threshold)


def scan(docs: DataFrame, labelled=None, doc_id="doc_id", text="text", path="source") -> DataFrame:
    """Every candidate of ``docs`` with its features, probability and ``secret``.

    ``labelled``: findings with FEATURES and label; by default those that ``rule_labels`` tells.
    Repeated rows and null ids give their candidates as any row does.
    """
    found = materialise(candidates(docs, doc_id, text, path), "candidates")
    rows = materialise(features(found, dictionary(docs, found, text)), "features")
    return remove_false_positives(rows, rule_labels(rows) if labelled is None else labelled)
