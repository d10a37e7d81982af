"""Secret scans with a random forest for false-positive removal; DataFrame functions only.

Candidates are found by one pattern, tried once at each run of token characters: keys with known beginnings, private key blocks up to
their END line, signed tokens, values of 6 or more characters assigned to names with words such as `password` or `api_key` in them,
and any run of 16 or more token characters with a digit that isn't a name itself. Texts without a candidate are passed over first;
cutting the others at the pattern gives what stands between candidates, hence each one's place and neighbours, without leaving the JVM.

Features of a candidate (`FEATURES`): its length and kinds of characters, character transitions (changes of kind, common
letter pairs, distinct characters), dictionary coverage (share of its characters in common words), path signs
(slashes, URL or file before it), and neighbouring words (secret words, an assignment, quotation marks; words of examples,
digests, identifiers). The forest is trained from labelled findings, `labelled_findings`: by default those lines of
`labelled_findings.py`, labelled by hand, that are for training, and a table of made-up ones, generated in Spark by hashing row
numbers; the other lines are for measuring. Trained trees become nested CASE expressions; a candidate's probability is the
mean of its trees' leaves.

A finding is reported if the probability is `THRESHOLD` or more. `redact` replaces reported values in their places
with `[SECRET:kind]` and leaves every document in.

Defined cases: null and empty texts have no findings (and null stays null when redacting); a value that occurs twice is two
findings; of candidates that overlap the one that begins first counts, and at one place a name's value before a known kind before a
token; repeated rows are scanned each by itself; a table without text gives no findings; other columns are not read, and stay when
redacting, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labelled_findings import LINES

THRESHOLD, TREES, DEPTH, FINDINGS = 0.5, 24, 8, 6_000
NEAR = 48
#: What a finding labelled by hand weighs against a made-up one.
BY_HAND = 10.0
#: Names whose value is a candidate, whatever stands before them (DB_PASSWORD), and what may follow in the name (access_key_id).
_REST = r"(?:[_-][A-Za-z0-9]++)*+[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
PASSWORD = r"(?i:passw(?:or)?d|passwd|pwd)" + _REST + r"[^\s\"',;]{6,}+"
NAMED = r"(?i:secret|token|credentials?|(?:api|access|auth|private|signing)[_-]?key)" + _REST + r"[A-Za-z0-9+/_.~=-]{6,}+"
_T = "[A-Za-z0-9+/_-]"
#: A run with an assignment after it, and a name within.
ASSIGNED = rf"(?={_T}{{3,}}+[\"']?[ \t]{{0,3}}[:=]){_T}*?(?:{PASSWORD}|{NAMED})"
KINDS = {
    "private_key": r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----[\s\S]*?-----END [A-Z ]*+(?<=PRIVATE KEY)-----",
    "signed_token": r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "cloud_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])",
    "service_key": r"(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}+",
    "password": PASSWORD,
    "token": rf"(?={_T}{{16}})(?=[A-Za-z+/_-]*+[0-9]){_T}++(?!=[\"']?{_T})={{0,2}}+",
}
_KNOWN = [k for k in KINDS if k not in ("password", "token")]
PATTERN = rf"(?<!{_T})(?:{ASSIGNED}|" + "|".join(KINDS[k] for k in [*_KNOWN, "token"]) + ")"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
DICTIONARY = (
    "access account action address admin agent alpha android application archive article assets auth author backup banner basic beta block board branch browser buffer build button cache call card center change channel "
    "check class client cloud code color column comment commit common company component config connect console contact container content context control cookie core count country create custom data database date debug "
    "default delete design detail device dialog digest document domain download driver editor element email enable encode engine entry error event example export factory feature field file filter final first folder font form "
    "format frame function gateway general global graph group handler hash header height help history home host html http icon image import index info input install instance integer interface internal item java json kernel label "
    "language last layer layout level library license light limit line link linux list local location login logo main manager master media member menu message meta method mobile model module monitor name native network news node "
    "note number object online open option order output package page panel param parent partner password path pattern payload people phone photo platform player plugin point policy port post press preview print private process "
    "product profile program project property provider public query queue random range reader record redirect region release remote render report request resource response result return review role root route sample schema screen "
    "script search section secure select server service session setting share shop side simple site size small social source space stack standard start state static status storage store stream string student style submit support "
    "system table target task team template test text theme thread time title token tool track training transfer type unit update upload user util value vector version video view visual web widget width window word work world write year"
).split()
SECRET_WORDS = r"(secret|token|passw|pwd|credential|api.?key|access.?key|private|auth|bearer|signing)"
OTHER_WORDS = r"\b(example|sample|dummy|placeholder|sha-?\d|md5|digest|checksum|commit|revision|hash|uuid|guid|isbn|order|invoice|phone|call|card|account no|session id|request id|trace|build|version|tracking|etag|serial)\b"
FEATURES = ("length", "letters", "capitals", "digits", "signs", "hexadecimal", "changes", "pairs", "distinct", "dictionary", "slashes", "in_path", "secret_word", "other_word", "assigned", "quoted", "known")


def spots(text: Column) -> Column:
    """All candidates of a text: array of struct(start, match, before, after)."""
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.struct(matches.alias("m"), F.split(text, PATTERN, -1).alias("gap"))


def value_of(match: Column) -> tuple[Column, Column]:
    """Kind and value of a candidate: a name's value is what is assigned, and of a known kind if it begins like one."""
    assigned = F.regexp_extract(match, r"[:=][ \t]*[\"']?([^\s\"',;]+)$", 1)
    value = F.when(match.rlike(f"^{ASSIGNED}$"), assigned).otherwise(match)
    kind = F.when(match.rlike(f"^{_T}*?{PASSWORD}$"), "password").otherwise(F.lit("token"))
    for name in reversed(_KNOWN):
        kind = F.when(value.rlike("^" + KINDS[name]), name).otherwise(kind)
    return kind, value


def features(v: Column, kind: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.greatest(F.length(v), F.lit(1))
    low = F.lower(v)

    def times(what: str, of: Column = v) -> Column:
        return F.regexp_count(of, F.lit(what)).cast("double")

    known = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    letters = times("[A-Za-z]")
    return {
        "length": F.log1p(n.cast("double")),
        "letters": letters / n,
        "capitals": times("[A-Z]") / n,
        "digits": times("[0-9]") / n,
        "signs": times("[^A-Za-z0-9]") / n,
        "hexadecimal": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "changes": times("(?<=[a-z])(?![a-z])(?!$)|(?<=[A-Z])(?![A-Z])(?!$)|(?<=[0-9])(?![0-9])(?!$)") / n,
        "pairs": times(f"(?=(?:{PAIRS}))", low) / F.greatest(letters, F.lit(1.0)),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)),
        "dictionary": (n - F.length(F.regexp_replace(low, known, ""))) / n,
        "slashes": times("[/]") / n,
        "in_path": before.rlike(r"(?:https?://|www\.|file:|[\w.]/)\S*$").cast("double"),
        "secret_word": F.lower(before).rlike(SECRET_WORDS + r"\W{0,6}\w{0,8}\W{0,6}$").cast("double"),
        "other_word": F.lower(F.concat(F.right(before, F.lit(20)), F.lit(" "), F.left(after, F.lit(16)))).rlike(OTHER_WORDS).cast("double"),
        "assigned": before.rlike(r"[:=]>?\s{0,3}[\"'`]?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "known": (kind != "token").cast("double"),
    }


def featured(rows: DataFrame) -> DataFrame:
    """The columns of FEATURES for rows with value, kind, before, after."""
    return rows.withColumns(features(*map(F.col, ("value", "kind", "before", "after"))))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """value, kind, before, after, label, weight: made-up findings and those for training of the ones labelled by hand."""
    return made_up_findings(spark, n).withColumn("weight", F.lit(1.0)).unionByName(by_hand(spark, LINES[::2]).withColumn("weight", F.lit(BY_HAND)))


def by_hand(spark: SparkSession, lines: tuple) -> DataFrame:
    """value, kind, before, after, label of the candidates in lines: 1 if it is the line's secret."""
    told = F.array(*(F.struct(F.lit(text).alias("text"), F.lit(secret).cast("string").alias("secret")) for text, secret in lines))
    rows = common.cut(spark.range(1).select(F.explode(told).alias("r")).select("r.*"), "by-hand")
    rows = candidates(rows).select("doc.secret", F.explode("c").alias("c"))
    return rows.select("c.value", "c.kind", "c.before", "c.after", F.coalesce(F.col("c.value") == F.col("secret"), F.lit(False)).cast("double").alias("label"))


def made_up_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """value, kind, before, after, label: all from hashes of row numbers."""
    i = F.col("id")

    def h(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)

    def pick(salt: str, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))

    def size(salt: str, low: int, high: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(high - low + 1)) + low).cast("int")

    b64 = F.base64(F.unhex(F.concat(h("x"), h("y"))))
    alnum = F.regexp_replace(b64, "[+/=]", "")
    word = lambda s: pick(s, DICTIONARY)
    prose = lambda s: F.concat(pick(s + "1", ["the ", "and so ", "of our ", "then a ", "with ", "is "]), word(s + "2"), F.lit(" "), word(s + "3"), F.lit(" "))
    secret_lead = F.concat(prose("p"), pick("k", ["token", "secret", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "password", "credentials", "private_key", "AUTH TOKEN", "Bearer"]), pick("o", [" = \"", "=\"", ": \"", "='", "=", ": ", " "]))
    plain_lead = F.concat(prose("p"), pick("d", ["", "", "see ", "number ", "id "]))
    digest_lead = F.concat(prose("p"), pick("e", ["sha256: ", "md5 = \"", "commit ", "checksum ", "revision ", "etag: \"", "digest=", "build ", "uuid: ", "example token = \"", "request id: "]))
    path_lead = F.concat(prose("p"), pick("f", ["https://example.com/", "www.example.org/a/", "file:/srv/", "/usr/lib/", "assets/img/"]))
    hexes = F.left(F.concat(h("x"), h("y")), size("n", 24, 64))
    number = F.left(F.regexp_replace(F.concat(h("x"), h("y")), "[a-f]", ""), size("n", 16, 20))
    mark = pick("j", ["-", "_", "/"])
    words = F.concat(word("w1"), mark, word("w2"), mark, word("w3"), mark, F.left(F.regexp_replace(h("q"), "[a-f]", ""), F.lit(2)))
    uuid = F.concat_ws("-", *(F.substring(h("x"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    upper = F.left(F.upper(F.concat(h("x"), h("y"))), size("n", 32, 48))
    prefixed = F.concat(pick("g", ["ghp_", "sk-", "sk_live_", "xoxb-", "AIza"]), F.left(alnum, size("n", 24, 40)))
    repeated = F.repeat(pick("r", ["0123456789abcdef", "abc123", "xxxxxxxx1", "1234", "00000000"]), 4)
    makes = [
        (hexes, "token", secret_lead, 1), (F.left(alnum, size("n", 20, 48)), "token", secret_lead, 1), (upper, "token", secret_lead, 1),
        (prefixed, "service_key", F.when(F.col("id") % 24 < 12, secret_lead).otherwise(plain_lead), 1), (F.concat(F.lit("AKIA"), F.left(F.upper(h("x")), F.lit(16))), "cloud_key", plain_lead, 1),
        (hexes, "token", digest_lead, 0), (number, "token", plain_lead, 0), (words, "token", F.when(F.col("id") % 24 < 12, secret_lead).otherwise(plain_lead), 0),
        (F.concat(words, F.lit("/"), F.left(h("z"), F.lit(12))), "token", path_lead, 0), (uuid, "token", F.when(F.col("id") % 24 < 12, digest_lead).otherwise(plain_lead), 0),
        (repeated, "token", secret_lead, 0), (F.concat(word("w1"), word("w2"), F.left(h("z"), F.lit(3))), "password", secret_lead, 1),
        (F.concat(word("w1"), pick("v", ["horse", "tiger", "winter", "dragon", "monkey", "hunter", "summer"])), "password", secret_lead, 1), (F.concat(pick("v", ["horse", "tiger", "winter", "dragon", "hunter"]), F.left(number, F.lit(2))), "password", secret_lead, 1),
        (F.left(alnum, size("n", 10, 18)), "token", secret_lead, 1), (F.left(hexes, size("n", 10, 18)), "token", secret_lead, 1), (F.left(F.regexp_replace(alnum, "[0-9]", ""), size("n", 16, 32)), "token", secret_lead, 1),
        (word("w1"), "password", secret_lead, 0), (word("w1"), "token", secret_lead, 0), (F.concat(word("w1"), mark, word("w2")), "token", secret_lead, 0), (F.concat(word("w1"), F.lit("."), word("w2")), "token", secret_lead, 0),
    ]

    # All kinds of all rows are written first: choosing among columns is a small plan, choosing among expressions isn't.
    made = [c for k, (value, _, before, _) in enumerate(makes) for c in (value.alias(f"v{k}"), before.alias(f"b{k}"))]
    rows = common.cut(spark.range(0, n, 1, 2).select("id", *made, pick("t", ["and", "for", "in the", "next", "."]).alias("next")), "made-up")

    def choose(options: list[Column]) -> Column:
        out = F.lit(None)
        for k, c in enumerate(options):
            out = F.when(i % len(makes) == k, c).otherwise(out)
        return out

    of = lambda name: [F.col(f"{name}{k}") for k in range(len(makes))]
    rows = rows.select(choose(of("v")).alias("value"), choose([F.lit(m[1]) for m in makes]).alias("kind"), choose(of("b")).alias("lead"), "next", choose([F.lit(float(m[3])) for m in makes]).alias("label"))
    close = F.when(F.col("lead").rlike("[\"']$"), F.right("lead", F.lit(1))).otherwise(F.lit(""))
    return rows.select("value", "kind", F.right("lead", F.lit(NEAR)).alias("before"), F.concat(close, F.lit(" "), F.col("next")).alias("after"), "label")


class Forest:
    """Trees as nested tuples (feature, cut, left, right) or leaves; expression() is the probability of being a secret."""

    def __init__(self, trees: list):
        self.trees = trees

    def sql(self, owner: str = "") -> str:
        """SQL over columns, or fields of `owner`, called as the features are."""

        def one(node) -> str:
            if not isinstance(node, tuple):
                return f"{float(node)!r}D"
            name, cut, left, right = node
            return f"CASE WHEN {owner}`{name}` <= {cut!r}D THEN {one(left)} ELSE {one(right)} END"

        return "(" + " + ".join(one(t) for t in self.trees) + f") / {len(self.trees)}"

    def expression(self) -> Column:
        return F.expr(self.sql())


_FORESTS: dict[str, Forest] = {}


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """A random forest from labelled findings (value, kind, before, after, label, weight)."""
    rows = common.cut(featured(findings).select(*FEATURES, "label", "weight").repartition(2, *FEATURES).sortWithinPartitions(*FEATURES, "label"), "findings")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5", minInstancesPerNode=3, weightCol="weight").fit(rows.select("features", "label", "weight"))

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = node.impurityStats().stats()
            return stats[1] / (stats[0] + stats[1])
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild())

    return Forest([read(t._java_obj.rootNode()) for t in model.trees])


def default_forest(spark: SparkSession) -> Forest:
    """The forest of the made-up findings, trained once in an application."""
    key = spark.sparkContext.applicationId
    if key not in _FORESTS:
        with common.scope(spark):
            _FORESTS[key] = train(labelled_findings(spark))
    return _FORESTS[key]


def candidates(docs: DataFrame) -> DataFrame:
    """doc (the whole row), f (matches and gaps) and c: an array of match, lead (what stands in the match before the value), value,
    kind, before and after; f and c are null for texts without candidates.

    Candidates stay in their text's row: nothing is shuffled, and rows that repeat stay apart.
    """
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("doc"), F.when(text.rlike(PATTERN), spots(text)).alias("f"))

    def one(m: Column, i: Column) -> Column:
        kind, value = value_of(m)
        lead = F.left(m, F.length(m) - F.length(value))
        before = F.concat(F.right(F.get("f.gap", i), F.lit(NEAR)), lead)
        return F.struct(m.alias("match"), lead.alias("lead"), value.alias("value"), kind.alias("kind"), before.alias("before"), F.left(F.get("f.gap", i + 1), F.lit(NEAR)).alias("after"))

    return rows.withColumn("c", F.transform("f.m", one))


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """candidates() with `p`, their probabilities, and `start`, the places of their values. The trees, applied within an array, don't
    swell the stage's generated code."""
    rows = candidates(docs)
    rows = rows.withColumn("x", F.transform("c", lambda c: F.struct(*(f.alias(k) for k, f in features(c["value"], c["kind"], c["before"], c["after"]).items()))))
    rows = rows.withColumn("p", F.expr(f"transform(x, x -> {forest.sql('x.')})")).drop("x")
    # Places: running lengths of gaps and matches.
    starts = F.aggregate(
        F.transform("c", lambda c, i: F.struct(F.length(F.get("f.gap", i)).alias("gap"), F.length(c["match"]).alias("match"), F.length(c["lead"]).alias("lead"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["match"]).alias("at"), F.array_append(a["out"], a["at"] + x["gap"] + x["lead"]).alias("out")),
        lambda a: a["out"],
    )
    return rows.withColumn("start", starts)


def findings(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, kind, probability, value_sha256, shown (first and last two characters) of each secret."""
    rows = judged(docs.select("doc_id", "text"), forest or default_forest(docs.sparkSession))
    rows = rows.where(F.size("c") > 0).select("doc.doc_id", F.explode(F.arrays_zip("c", "p", "start")).alias("x")).where(F.col("x.p") >= threshold)
    value = F.col("x.c.value")
    shown = F.concat(F.left(value, F.lit(2)), F.lit("…"), F.right(value, F.lit(2)))
    return rows.select("doc_id", F.col("x.start").cast("long").alias("start"), F.length(value).cast("long").alias("length"), F.col("x.c.kind").alias("kind"), F.round("x.p", 6).alias("probability"), F.sha2(value, 256).alias("value_sha256"), shown.alias("shown"))


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns and rows, with the found secrets' values replaced in their texts (and n_chars counted again)."""
    rows = judged(docs, forest or default_forest(docs.sparkSession))
    put = F.transform("c", lambda c, i: F.when(F.get("p", i) >= threshold, F.concat(c["lead"], F.lit("[SECRET:"), c["kind"], F.lit("]"))).otherwise(c["match"]))
    text = F.concat(F.array_join(F.transform(put, lambda p, i: F.concat(F.get("f.gap", i), p)), ""), F.element_at("f.gap", -1))
    rows = rows.withColumn("new", F.when(F.size("c") > 0, text))
    doc = F.col("doc").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.col("new").isNotNull(), doc).otherwise(F.col("doc")).alias("doc")).select("doc.*")
