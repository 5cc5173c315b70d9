"""Secret scan: pattern candidates, then a random forest that removes false positives.

One pattern finds candidates: known key formats, values assigned to telling
names, and long runs that mix letters and digits.  Splitting a text by the
pattern gives what stands between the candidates, and so each one's place and
neighbouring words, without a join or a shuffle.  Features are the length,
character classes and transitions, dictionary coverage, path context and
neighbouring words.  The forest is trained on labelled findings and then turned
into one SQL expression, so each row is judged where it is read.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# Names that announce a secret, words that announce another thing, and formats of known keys.
SECRET_NAMES = ["token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "auth", "bearer", "credential", "private_key"]
PLACEHOLDER_WORDS = ["example", "sample", "dummy", "placeholder", "changeme", "your", "test", "fake", "redacted", "xxxx", "todo", "insert"]
DIGEST_WORDS = ["sha1", "sha256", "sha512", "md5", "checksum", "digest", "commit", "uuid", "guid", "etag", "hash", "revision", "integrity", "order", "invoice"]
DICTIONARY = [
    "access", "account", "admin", "application", "archive", "backup", "base", "branch", "browser", "build", "cache", "client", "cloud", "cluster", "code", "config",
    "connection", "content", "controller", "core", "count", "create", "customer", "data", "database", "default", "delete", "deploy", "description", "develop", "device", "document",
    "domain", "download", "email", "engine", "error", "event", "export", "factory", "feature", "field", "file", "filter", "final", "first", "folder", "format", "function", "gateway",
    "global", "group", "handler", "header", "history", "home", "host", "image", "import", "index", "input", "instance", "internal", "item", "job", "json", "label", "language", "last",
    "layer", "library", "link", "list", "local", "location", "login", "main", "manager", "master", "member", "message", "method", "model", "module", "name", "network", "node", "number",
    "object", "online", "option", "order", "output", "page", "parameter", "parent", "password", "path", "player", "plugin", "policy", "port", "process", "product", "profile", "project", "property",
    "provider", "public", "query", "queue", "record", "release", "remote", "report", "request", "resource", "response", "result", "role", "root", "route", "sample", "schema",
    "script", "search", "secret", "select", "server", "service", "session", "setting", "shared", "snapshot", "source", "stage", "start", "state", "status", "storage", "store", "stream",
    "string", "submit", "summary", "support", "system", "table", "target", "task", "template", "test", "text", "time", "token", "total",
    "type", "update", "upload", "user", "value", "version", "view", "window", "worker",
]
#: Quantifiers have no upper bound, so that no part of a value is left, and are possessive, so that a search never goes back.
KNOWN_FORMATS = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}+\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}+",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35,}+",
    "stripe_key": r"\b[rs]k_live_[0-9A-Za-z]{16,}+",
    # A start shortly after another of the same run is skipped: both lead to the same dot.  It keeps runs of starts from being searched again and again.
    "jwt": r"\beyJ(?<!\beyJ[A-Za-z0-9_-]{0,255}eyJ)[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
_NAMES = "|".join(x.replace("_", "[_]") for x in SECRET_NAMES)
#: What leads up to an assigned value.  It is part of a match, and counts as context.
LEAD = rf"(?i:{_NAMES})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?"
#: A value next to a telling name, or a run of 20 characters and more with a digit in it.
ASSIGNED = LEAD + r"[A-Za-z0-9+/_=.!@%^&*~$-]{8,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
CANDIDATE = "|".join([*KNOWN_FORMATS.values(), ASSIGNED, RUN])
#: One of these stands in every match: what a text must contain to be searched at all.
SIGNS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "k_live_", "eyJ", "PRIVATE KEY-----"]
#: Characters on either side in which neighbouring words count.
NEARBY = 48

TREES, DEPTH, SEED, FINDINGS = 24, 6, 7, 6000
FEATURES = ["length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "syllables", "dictionary", "repeats", "hexadecimal", "known", "path", "named", "placeholder", "digest"]


def features(value: Column, before: Column, after: Column) -> Column:
    """The struct of features of a candidate between two stretches of text."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low, lead, tail = F.lower(value), F.lower(F.right(before, F.lit(NEARBY))), F.lower(F.left(after, F.lit(NEARBY)))
    share = lambda pattern, of=value: F.regexp_count(of, F.lit(pattern)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    words = lambda xs: "(" + "|".join(re.escape(x) for x in xs) + ")"
    columns = {
        "length": F.least(n, F.lit(200.0)),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[0-9])[^0-9]|(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.least(n, F.lit(36.0)),
        "syllables": share("[bcdfghjklmnpqrstvwxz][aeiou]", low),
        "dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))) / n,
        "repeats": flag(low.rlike(r"(.)\1{3}|(..)\2{3}|0123|1234|abcd")),
        "hexadecimal": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "known": flag(value.rlike("^(" + "|".join(KNOWN_FORMATS.values()) + ")$")),
        "path": flag(lead.rlike(r"(https?:|[\w.-]*/|\\)[^\s\"'=]*$") | value.rlike(r"/.*/|\.[a-z]{2,4}$")),
        "named": flag(lead.rlike(r"(?:" + _NAMES + r")[\"']?\s{0,3}([:=]|is)?\s{0,3}[\"']?$")),
        "placeholder": flag(F.concat_ws(" ", lead, low, tail).rlike(words(PLACEHOLDER_WORDS))),
        "digest": flag(lead.rlike(r"\b" + words(DIGEST_WORDS) + r"\b")),
    }
    return F.struct(*(columns[f].cast("double").alias(f) for f in FEATURES))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """A bounded table of findings with labels: ``value, before, after, label``, the same each time.

    Values come from hashes of a counter, set in the contexts in which scanners report them.
    """
    h = lambda salt, bits: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), bits)
    pick = lambda xs, salt: F.get(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int"))
    code = F.regexp_replace(F.base64(F.unhex(h("b", 256))), "[+/=]", "")
    sep = pick(["_", "-", "", "."], "sep")
    dictionary = F.concat(pick(DICTIONARY, "w1"), sep, pick(DICTIONARY, "w2"), sep, pick(DICTIONARY, "w3"), sep, pick(DICTIONARY, "w4"))
    assign = F.concat(pick(["the ", "", "\n", "set ", "export "], "a"), pick(SECRET_NAMES, "n"), pick([" = ", ": ", "=", ":"], "e"), pick(["\"", "'", ""], "q"))
    digest = F.concat(pick(["see ", "", "the ", "\n"], "a"), pick(DIGEST_WORDS, "d"), pick([" ", ": ", " = ", "="], "e"))
    path = F.concat(pick(["https://", "see /", "in ", ""], "a"), pick(DICTIONARY, "p"), F.lit("/"))
    words = F.concat(pick(DICTIONARY, "x"), F.lit(" "), pick(DICTIONARY, "y"), F.lit(" "))
    hexes = F.left(h("h", 256), F.lit(32) + F.lit(8) * F.pmod(F.col("id"), F.lit(5)).cast("int"))
    known = F.get(
        F.array(
            F.concat(F.lit("AKIA"), F.upper(F.left(F.regexp_replace(code, "[^A-Za-z0-9]", ""), F.lit(16)))),
            F.concat(F.lit("ghp_"), F.left(F.concat(code, code), F.lit(36))),
            F.concat(F.lit("xoxb-"), F.left(h("x", 256), F.lit(12)), F.lit("-"), F.left(code, F.lit(24))),
            F.concat(F.lit("AIza"), F.left(F.concat(code, code), F.lit(35))),
            F.concat(F.lit("sk_live_"), F.left(code, F.lit(24))),
        ),
        F.pmod(F.xxhash64("id", F.lit("k")), F.lit(5)).cast("int"),
    )
    cases = [  # value, before, label
        (hexes, assign, 1),
        (F.left(code, F.lit(20) + F.pmod(F.col("id"), F.lit(20)).cast("int")), assign, 1),
        (known, words, 1),
        (known, assign, 1),
        (F.concat(F.left(code, F.lit(10)), pick(["!", "@", "-", "_"], "s"), F.left(h("z", 256), F.lit(6))), assign, 1),
        (dictionary, assign, 0),
        (hexes, digest, 0),
        (hexes, path, 0),
        (F.concat(dictionary, F.lit("_"), F.col("id").cast("string")), words, 0),
        (F.concat(pick(PLACEHOLDER_WORDS, "o"), F.lit("_"), pick(SECRET_NAMES, "t"), F.lit("_"), F.left(h("o", 256), F.lit(4))), assign, 0),
        (F.repeat(pick(["x", "0", "1", "a", "*", "abcd", "1234"], "r"), F.lit(20)), assign, 0),
        (F.concat(F.left(h("u", 256), F.lit(8)), F.lit("-"), F.substring(h("u", 256), 9, 4), F.lit("-"), F.substring(h("u", 256), 13, 4), F.lit("-"), F.substring(h("u", 256), 17, 12)), digest, 0),
        (F.substring(F.regexp_replace(h("n", 512), "[a-f]", ""), 1, 24), words, 0),
        (F.concat_ws("/", pick(DICTIONARY, "f1"), pick(DICTIONARY, "f2"), F.col("id").cast("string"), pick(DICTIONARY, "f3")), words, 0),
    ]
    which = F.pmod(F.col("id"), F.lit(len(cases)))
    choose = lambda i: F.coalesce(*(F.when(which == k, c[i] if isinstance(c[i], Column) else F.lit(c[i])) for k, c in enumerate(cases)))
    return spark.range(0, n, 1, 1).select(choose(0).alias("value"), choose(1).alias("before"), F.concat(pick(["\"", "'", " ", "\n"], "q2"), words).alias("after"), choose(2).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """A random forest on ``value, before, after, label``, as a SQL expression over the features of ``f``: the share of trees that vote 1."""
    findings = stored(findings, "labelled-findings")
    rows = findings.select(features(F.col("value"), F.col("before"), F.col("after")).alias("f"), "label").select("f.*", "label").coalesce(1)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(rows)
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(rows)
    return "(" + " + ".join(_tree(t.toDebugString) for t in model.trees) + f") / {len(model.trees)}.0"


def _tree(text: str) -> str:
    """A tree's printed form as nested CASE expressions over ``f``."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def read(at: int) -> tuple[str, int]:
        if m := re.match(r"Predict: ([\d.]+)", lines[at]):
            return m[1], at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        yes, at = read(at + 1)
        no, at = read(at + 1)
        return f"CASE WHEN f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D THEN {yes} ELSE {no} END", at

    return f"CAST({read(0)[0]} AS DOUBLE)"


def scan(docs: DataFrame, forest: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__secret_pieces, __secret_candidates``: the stretches between candidates (none without one), and ``value, start, kind, score`` of each.

    Null and empty texts have no candidates.  Every row is judged for itself, so repeated rows get equal results.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    gate = body.rlike("[0-9:=]")
    for sign in SIGNS:
        gate = gate | body.contains(sign)
    # Exploding one value keeps the optimiser from copying the search to every later use of it.
    matches = F.when(gate, F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    held = docs.withColumn("__matches", F.explode(F.array(matches)))
    some = F.size("__matches") > 0
    lead = lambda m: F.regexp_extract(m, f"^{LEAD}(?=.{{8}})", 0)
    held = held.withColumn("__pieces", F.explode(F.array(F.when(some, F.split(body, CANDIDATE, -1)).otherwise(F.expr("cast(array() as array<string>)")))))
    held = held.withColumn("__leads", F.transform("__matches", lead))
    held = held.withColumn("__values", F.zip_with("__matches", "__leads", lambda m, x: F.substr(m, F.length(x) + 1)))
    named = held.withColumn("__secret_pieces", F.transform("__pieces", lambda p, i: F.concat(p, F.coalesce(F.get("__leads", i), F.lit("")))))
    # Starts (from 0) by running lengths of what stands before.
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("__values") - 1),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get("__secret_pieces", i)) + F.length(F.get("__values", i))).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(F.get("__secret_pieces", i)))).alias("out")
        ),
        lambda acc: acc["out"],
    )
    measured = F.transform(
        "__values",
        lambda v, i: F.struct(v.alias("value"), F.get("__starts", i).alias("start"), features(v, F.get("__secret_pieces", i), F.get("__secret_pieces", i + 1)).alias("f")),
    )
    empty = "cast(array() as array<struct<value:string,start:int,kind:string,score:double>>)"
    formats = "".join(f" WHEN c.value RLIKE '{_quoted(f'^(?:{p})$')}' THEN '{k}'" for k, p in KNOWN_FORMATS.items())
    scored = f"transform(__m, c -> struct(c.value AS value, c.start AS start, CASE{formats} ELSE 'generic' END AS kind, {forest.replace('f.', 'c.f.')} AS score))"
    held = named.withColumn("__starts", F.when(F.size("__values") > 0, starts))
    held = held.withColumn("__m", F.explode(F.array(F.when(F.size("__values") > 0, measured))))
    held = held.withColumn("__secret_candidates", F.when(F.size("__values") > 0, F.expr(scored)).otherwise(F.expr(empty)))
    return held.drop("__matches", "__pieces", "__leads", "__values", "__starts", "__m")


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def findings(docs: DataFrame, forest: str, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``key, start, length, kind, secret, score`` of each candidate that the forest takes for a secret."""
    found = scan(docs.select(key, text), forest, text).select(key, F.explode("__secret_candidates").alias("c")).where(F.col("c.score") >= threshold)
    return found.select(key, "c.start", F.length("c.value").alias("length"), "c.kind", F.col("c.value").alias("secret"), "c.score")


def redact(docs: DataFrame, forest: str, text: str = "text", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in the text replaced by the mark; all else, null texts included, stays as it is."""
    parts = F.zip_with("__secret_pieces", "__secret_candidates", lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.when(c["score"] >= threshold, F.lit(mark)).otherwise(F.coalesce(c["value"], F.lit("")))))
    hit = F.exists("__secret_candidates", lambda c: c["score"] >= threshold)
    out = scan(docs, forest, text)
    return out.withColumn(text, F.when(hit, F.array_join(parts, "")).otherwise(F.col(text))).drop("__secret_pieces", "__secret_candidates")
