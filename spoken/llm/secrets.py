"""Secret scans with a random forest that removes false positives, in DataFrame and SQL functions throughout.

Candidates are any value after a telling word and an assignment sign, passwords of URIs, whole private-key blocks, well-known key
formats, and elsewhere runs of 16 or more key characters with a digit. They are cut out of whole texts with a marker character, so that
each keeps its neighbours. Features are candidate length, transitions between character classes, share covered by dictionary words,
path, and neighbouring words. The forest (``pyspark.ml``) is trained on labelled findings and then written as SQL
expressions, so that findings are scored inside their row: no explode, no shuffle, whatever a text's length.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed

MARK = "\u0001"
#: Public key formats (cloud access keys, repository and chat tokens, JSON web tokens) and the generic run.
FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]*"
GENERIC = r"[0-9A-Za-z_+/-]{16,}+={0,2}"
BEFORE, AFTER = 48, 32  # characters of the neighbourhood
#: Dictionary words for coverage, words that announce a secret, and words that announce something else.
DICTIONARY = "about access account address article authorization available because before between business change client company config content control country create customer data default delete description development document download email english error event example export factory field file find following format function general group handler have image import index information input install interface item language license list load local manager market message method model module name network number object office option order output package page param parent password path people permission person phone place please policy position price private process product program project public query read record release report request research response result return review right sample search section select server service session setting should sign simple site size software source start state status store string style support system table template test text that their there these they this time title token total type update upload user value version view water website which with work world would write year".split()
TELLS = "token|passw(?:or)?d|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|key"
DENIES = "commit|sha1?|sha256|md5|hash|checksum|digest|uuid|guid|id|isbn|order|ticket|version|rev(?:ision)?|build|example|sample|dummy|placeholder|test|fake|url|href|path"
PATHS = r"(?:^|[/._-])(?:tests?|specs?|fixtures?|examples?|samples?|docs?|mocks?|vendor|node_modules|lock)(?:[/._-]|$)"
STRONG = "passw(?:or)?d|passwd|pwd|passphrase|secret|credential"
PLACEHOLDER = r"^(?:<.*>?|\[.*\]?|\{.*|\$[{(].*|\$[a-z_]+|\*+|\.+|x+|%[sdv]|your.*|null|none|nil|true|false|undefined|self\..*|this\..*)$|\w\(|\.env\b|environ"
#: Groups 1 and 2: a URI up to its password, and that; 3 and 4: a telling word with its sign, and the value up to the closing quote or
#: the next blank; 5: a private-key block (to its end line, or over the lines of key characters that follow), a format, a run.
_LINE = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_BLOCK = rf"-----BEGIN {_LINE}(?:(?:[^-]++-(?!----)){{0,64}}[^-]*+-----END {_LINE}|(?:(?:\s|\\[rn])*+[0-9A-Za-z+/=]{{16,}}+){{0,400}})"
_URI, _PASSWORD = r"://[^\s/:@\"'<>]{0,128}:", r"(?![0-9]{1,5}/)[^\s\"'<>]+(?=@[^\s@])"
_TELL = rf"(?=[TtPpSsAaCcBbKk])(?i:{TELLS}|passphrase)(?:\\?[\"'`])?\]?[ \t]{{0,8}}(?:={{1,3}}>?|:=?)[ \t]{{0,8}}(?:\\?[\"'`])?+"
_QUOTED = "|".join(rf"(?<={q})(?!{q})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+){{0,64}}(?={q})" for q in "\"'`")
_VALUE = rf"(?!-----BEGIN |[^\s\"'`]*://[^\s/@\"'`]*@)(?=[^\s=])(?:{_QUOTED}|[^\s\"'`]*[^\s\"'`,;.)\]}}\\])"
_NAMED = r"(?![0-9A-Za-z_+/-]{0,64}?(?i:" + TELLS + r")[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?[^\s\"'=:])"
CANDIDATE = rf"({_URI})({_PASSWORD})|({_TELL})({_VALUE})|({_BLOCK}|(?<![0-9A-Za-z_+/-])(?:{FORMATS}|(?=[A-Za-z_+/-]{{0,64}}[0-9]){_NAMED}{GENERIC}))"
MARKED = f"$1$3{MARK}$2$4$5{MARK}"
FEATURES = ("length", "digits", "to_digit", "to_letter", "to_case", "hexadecimal", "distinct", "vowels", "longest_letters", "coverage", "known", "tells", "denies", "assigned", "quoted", "path", "symbols", "strong", "uri", "placeholder", "lower")
TREES, DEPTH, FINDINGS, THRESHOLD = 15, 5, 6000, 0.5


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numbers of a finding from its text, the characters on both sides, and its document's path."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / n
    rest = F.regexp_replace(F.lower(candidate), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    near = F.lower(before)
    values = {
        "length": n,
        "digits": share("[0-9]"),
        "to_digit": share("[A-Za-z](?=[0-9])"),
        "to_letter": share("[0-9](?=[A-Za-z])"),
        "to_case": share("[a-z](?=[A-Z])"),
        "hexadecimal": flag(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "vowels": share("[AEIOUaeiou]"),
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(candidate, F.lit("[a-z]+|[A-Z]+"), F.lit(0)), F.length)), F.lit(0)) / n,
        "coverage": 1 - F.length(rest) / n,
        "known": flag(candidate.rlike(rf"^(?:{FORMATS})$|^-----BEGIN ")),
        "tells": flag(near.rlike(rf"(?:{TELLS}|passphrase)(?:\\?[\"'`])?\]?\s*(?:={{1,3}}>?|:=?|is)?\s*(?:\\?[\"'`])?$")),
        "denies": flag(near.rlike(rf"(?:^|[^a-z])(?:{DENIES})[\"']?\s*(?:[:=#]|is|no\.?)?\s*[\"']?$")),
        "assigned": flag(near.rlike(r"[:=]>?\s*(?:\\?[\"'`])?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike(r"^\\?[\"'`]")),
        "path": flag(F.lower(path).rlike(PATHS)),
        "symbols": share("[^0-9A-Za-z]"),
        "strong": flag(near.rlike(rf"(?:{STRONG})[^a-z]*$")),
        "uri": flag(near.rlike(f"{_URI}$")),
        "placeholder": flag(F.lower(candidate).rlike(PLACEHOLDER)),
        "lower": flag(candidate.rlike(r"^\p{Ll}+$")),
    }
    return {k: values[k].cast("double") for k in FEATURES}


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, path, secret): findings made by rule, by kind of secret and of look-alike, from hashes of a counter."""
    hexed = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    based = lambda salt: F.regexp_replace(F.base64(F.unhex(hexed(salt))), "[=]", "")
    pick = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    word = lambda salt: pick(salt, DICTIONARY)
    title = lambda salt: F.initcap(word(salt))
    size = lambda salt, least, most: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most - least + 1)) + least).cast("int")
    cut = lambda text, salt, least, most: F.substr(text, F.lit(1), size(salt, least, most))
    tell = pick("tell", ["token", "password", "secret", "api_key", "access_key", "auth", "pwd", "credential", "Bearer"])
    deny = pick("deny", ["commit", "sha", "md5", "hash", "checksum", "uuid", "id", "order", "version", "example", "url"])
    sign = pick("sign", ["=", " = ", ": ", "=\"", " = \"", " ", ": '"])
    prose = F.concat(word("p1"), F.lit(" "), word("p2"), F.lit(" "))
    upper = F.translate(F.upper(F.substr(based("a"), F.lit(1), F.lit(40))), "018+/", "ABCDE")
    strong = pick("strong", ["password", "passwd", "pwd", "secret", "PASSWORD", "db_password", "passphrase"])
    assign = pick("assign", ["=", " = ", ": ", "=\"", " = \"", ": \"", ": '", "='"])
    server = F.concat(prose, pick("scheme", ["postgres", "mysql", "amqp", "redis", "mongodb+srv", "https", "ftp"]), F.lit("://"), pick("user", ["admin", "root", "app", "user", ""]), F.lit(":"))
    chosen = F.concat(F.translate(title("c1"), "aeio", "4310"), (F.col("id") % 97).cast("string"), pick("c2", ["", "!", "#", "$", "_x"]))
    mixed = cut(F.translate(based("m"), "+/ABCDEFGH", "!.$%@~:&*^"), "mixed", 8, 24)
    letters = cut(F.regexp_replace(based("l"), "[0-9+/]", ""), "letters", 8, 24)
    syllables = F.concat(*(pick(f"y{i}", "ba ne ti ro lu ma den sor vel kin ta gra mo per".split()) for i in range(2)), pick("y2", ["", "s", "ing", "lo", "mente", "ter", "ung"]))
    kinds = [
        (chosen, F.concat(prose, strong, assign), 1),
        (mixed, F.concat(prose, F.when(F.col("id") % 3 == 0, tell).otherwise(strong), assign), 1),
        (letters, F.concat(prose, F.when(F.col("id") % 3 == 0, tell).otherwise(strong), assign), 1),
        (cut(hexed("e"), "short", 8, 15), F.concat(prose, tell, assign), 1),
        (F.when(F.col("id") % 2 == 0, chosen).otherwise(mixed), server, 1),
        (cut(based("v"), "uri", 8, 30), server, 1),
        (F.concat(F.lit("-----BEGIN "), pick("pem", ["RSA ", "EC ", "", "OPENSSH "]), F.lit("PRIVATE KEY-----\n"), based("k1"), based("k2"), F.lit("\n-----END PRIVATE KEY-----")), prose, 1),
        (F.concat(word("v1"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("_"), word("v2"))).otherwise(F.lit(""))), F.concat(prose, F.when(F.col("id") % 3 == 0, tell).otherwise(strong), assign), 0),
        (pick("none", ["null", "None", "true", "false", "****", "${TOKEN", "<password>", "your_password", "%s", "{{", "os.environ[", "process.env.TOKEN", "getToken(", "string", "self.token", "undefined", "xxxxxxxx", "$PASSWORD"]), F.concat(prose, F.when(F.col("id") % 3 == 0, tell).otherwise(strong), assign), 0),
        (syllables, F.concat(prose, pick("weak", ["the key", "Key", "auth", "a token", "secret", "password", "The secret"]), pick("colon", [": ", " = ", " : "])), 0),
        ((F.col("id") % 9973).cast("string"), F.concat(prose, pick("count", ["key", "token", "auth", "keys_token"]), pick("colon2", [": ", " = ", "="])), 0),
        (pick("shown", ["password", "pass", "<password>", "${PASSWORD", "****", "secret", "xxx", "your_password", "$PASSWORD"]), server, 0),
        (cut(hexed("h"), "n", 16, 64), F.concat(prose, tell, sign), 1),
        (cut(based("b"), "n", 20, 43), F.concat(prose, tell, sign), 1),
        (F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(16))), pick("k", ["", "key ", "= ", "the "]), 1),
        (F.concat(F.lit("ghp_"), F.substr(F.translate(based("g"), "+/", "ab"), F.lit(1), F.lit(36))), prose, 1),
        (cut(F.upper(hexed("u")), "n", 16, 64), F.concat(F.upper(tell), sign), 1),
        (cut(hexed("c"), "n", 32, 64), F.concat(prose, deny, sign), 0),
        (F.concat(word("w1"), title("w2"), title("w3"), (F.col("id") % 100).cast("string")), prose, 0),
        (F.concat(word("s1"), F.lit("-"), word("s2"), F.lit("-"), word("s3"), F.lit("-"), (F.col("id") % 10000).cast("string")), pick("t", ["path ", "see ", "url=", "key ", "token "]), 0),
        (F.concat(word("d1"), F.lit("/"), word("d2"), F.lit("/"), word("d3"), (F.col("id") % 10).cast("string")), F.concat(prose, sign), 0),
        (F.concat(F.lit("20"), F.substr(F.translate(hexed("d"), "abcdef", "123456"), F.lit(1), F.lit(14)), F.lit("T00")), F.concat(prose, deny, sign), 0),
        (F.concat_ws("-", *(F.substr(hexed("i"), F.lit(a), F.lit(b)) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), pick("x", ["id ", "uuid=", "guid: ", ""]), 0),
        (F.concat(F.repeat(pick("r", ["x", "0", "a", "Z", "-"]), 14), F.lit("123456")), F.concat(tell, sign), 0),
    ]
    rows = spark.range(n, numPartitions=4)
    choose = lambda i: F.element_at(F.array(*(k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds)), (F.col("id") % len(kinds) + 1).cast("int"))
    quote = F.when(choose(1).rlike("[\"']$"), F.substring(choose(1), -1, 1)).otherwise(F.lit(" "))
    path = F.when(choose(2) == 0, pick("q", ["src/main.py", "tests/data.py", "docs/a.md", "package-lock", "src1", ""])).otherwise(pick("q", ["src/main.py", "deploy.env", "src0", "", "config.yml", "docs/a.md"]))
    return rows.select(choose(0).alias("candidate"), choose(1).alias("before"), F.concat(quote, word("z")).alias("after"), path.alias("path"), choose(2).cast("double").alias("secret"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """The forest as nested tuples: (feature, threshold, left, right) or the share of secrets at a leaf."""
    found = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = findings.select("secret", *(c.alias(k) for k, c in found.items()))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=64, seed=11).fit(rows)

    def walk(node):
        if node.subtreeDepth() == 0:
            counts = node.impurityStats().stats()
            total = sum(counts)
            return (counts[1] / total) if total else 0.5
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return [walk(tree._java_obj.rootNode()) for tree in model.trees]


def probability(forest: list, values: Column) -> Column:
    """Mean of the trees' leaf shares for a struct of features."""

    def of(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        index, threshold, left, right = node
        return F.when(values[FEATURES[index]] <= threshold, of(left)).otherwise(of(right))

    total = F.lit(0.0)
    for tree in forest:
        total = total + of(tree)
    return total / len(forest)


def _findings(text: Column, path: Column, forest: list) -> Column:
    """array<struct<nth, start, candidate, score>> of a text without ``MARK``; start is its 0-based code point."""
    parts = F.split(F.regexp_replace(text, CANDIDATE, MARKED), MARK)
    places = F.sequence(F.lit(0), F.floor(F.size(parts) / 2) - 1)  # text, candidate, text, candidate, ..., text
    some = F.when(F.size(parts) > 1, places).otherwise(F.array().cast("array<bigint>"))

    def one(i):
        own = F.get(parts, (2 * i + 1).cast("int"))
        before, after = F.right(F.get(parts, (2 * i).cast("int")), F.lit(BEFORE)), F.left(F.get(parts, (2 * i + 2).cast("int")), F.lit(AFTER))
        return F.struct(i.alias("nth"), own.alias("candidate"), F.struct(*(c.alias(k) for k, c in features(own, before, after, path).items())).alias("x"))

    return F.transform(F.transform(some, one), lambda f: F.struct(f["nth"].alias("nth"), f["candidate"].alias("candidate"), probability(forest, f["x"]).alias("score")))


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK, " ")


def _path(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def scan_secrets(docs: DataFrame, forest: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, nth, candidate_sha256, length, score, is_secret): a row for each candidate of ``docs(doc_id, text[, source])``.

    ``nth`` counts a text's candidates from 0. Null and empty texts have none. Repeated rows are scanned each. A missing source is an
    empty path. The secret itself is not returned, only its digest.
    """
    forest = train(labelled_findings(docs.sparkSession)) if forest is None else forest
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _clean(F.col("text").cast("string")).alias("text"), _path(docs).alias("path")).filter(F.col("text").rlike(CANDIDATE))
    found = rows.select("doc_id", F.inline(_findings(F.col("text"), F.col("path"), forest)))
    return found.select("doc_id", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, forest: list | None = None, threshold: float = THRESHOLD, instead: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all rows, columns and other characters stay as they are
    (but for U+0001 in a text with a secret, which becomes a blank). Null texts stay null."""
    forest = train(labelled_findings(docs.sparkSession)) if forest is None else forest
    parts = F.split(F.regexp_replace(F.col("text_"), CANDIDATE, MARKED), MARK)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & F.array_contains(F.col("bad_"), ((i - 1) / 2).cast("bigint")), F.lit(instead)).otherwise(x)), "")
    rows = keyed(docs).withColumn("text_", _clean(F.col("text"))).withColumn("has_", F.col("text_").rlike(CANDIDATE))
    source = F.coalesce(F.col("row_.source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    bad = F.transform(F.filter(_findings(F.col("text_"), source, forest), lambda f: f["score"] >= threshold), lambda f: f["nth"])
    rows = rows.withColumn("bad_", F.when(F.col("has_"), bad)).withColumn("new_", F.when(F.size("bad_") > 0, joined).otherwise(F.col("text")))
    return rows.select(*(F.col("new_").alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns))
