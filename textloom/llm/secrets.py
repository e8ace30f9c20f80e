"""Secret scanning: candidates by pattern, false positives removed by a random forest, native to Spark SQL.

Candidates are runs of 16 or more characters that keys and tokens are made of, and any value of 4 or more characters
that a cue (password, token, ...) and an assignment introduce. The forest looks at a candidate's length, character
transitions, dictionary coverage, the document's path and the neighbouring words. It is trained from labelled findings,
whose features come from the same Spark expressions, and scores as one Spark expression.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import forest_column, grow_forest

_WS = r"[\x20\x09-\x0D]+"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"

#: Words that make up names and prose, and cues of neighbouring words and paths.
DICTIONARY = "about access account action after again amount application archive array because before between build button bytes change check client cloud code command commit common config connection container content context controller count create current data database default delete description details device document driver element engine error event example factory field file filter final first folder format function group handler header home host image index input install integer interface internal item java language large length level license line list local manager master message method model module name network node number object option output package page parameter parent path people picture place plugin point process product profile project property provider public query random record release report request resource response result return right root sample schema script search section select server service session setting should simple source stage start state static status storage store stream string style system table target task template test text the theme there time title type under unit update upload user value version view where which window with work world write and tion ing ver ent ould able ment ness ight".split()
_CUE = r"token|secret|passw|passwd|pwd|api_?key|apikey|auth|bearer|credential|private|access_?key|signing"
#: A cue that ends what precedes a value, with the assignment between them; quotes may open the value.
_ASSIGN = r"(?:" + _CUE + r")[a-z0-9_\-]*[\"']?\s*(?::=|=>|[=:])\s*[\"']?$"
#: A word that holds cue, assignment and value.
_WITHIN = r"(?i)^(.*?(?:" + _CUE + r")[a-z0-9_\-]*[\"']?(?::=|=>|[=:])[\"']?)([^\"']{4,}?)[\"',;)]*$"
#: A value that an assignment in front introduces, without what may stand around it.
_VALUE = r"^[\"']?([^\"']{4,}?)[\"',;)]*$"
_ANTI = r"commit|sha\d*|md5|hash|checksum|digest|revision|uuid|guid|example|sample|dummy|placeholder|test|http|href|src|etag|version"
_TEST_PATH = r"test|example|sample|fixture|mock|demo|docs?/|spec"
_LIVE_PATH = r"\.env|secret|cred|config|deploy|settings|prod"
_PLACEHOLDER = r"(?i)x{5,}|0{8,}|1234567|abcdefg|your[_-]?|changeme|(.)\1{6,}"

FEATURES = ("length", "digits", "upper", "lower", "other", "transitions", "distinct", "dictionary", "hex", "placeholder", "cue", "anti", "assigned", "code", "test_path", "live_path", "known_prefix", "dashes")


def _part(core: Column, pattern: str) -> Column:
    return F.regexp_count(core, F.lit(pattern)).cast("double") / F.length(core)


def candidate_features(core: Column, before: Column, path: Column) -> Column:
    """An array of FEATURES, doubles. before: the words in front and what precedes the candidate in its own word."""
    flag = lambda c: c.cast("int").cast("double")
    low, words = F.lower(core), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return F.array(
        F.least(F.length(core), F.lit(200)).cast("double"),
        _part(core, "[0-9]"),
        _part(core, "[A-Z]"),
        _part(core, "[a-z]"),
        _part(core, "[^A-Za-z0-9]"),
        _part(core, "[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"),
        F.size(F.array_distinct(F.split(core, ""))).cast("double") / F.least(F.length(core), F.lit(40)),
        F.lit(1.0) - F.length(F.regexp_replace(low, words, "")).cast("double") / F.length(core),
        flag(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(core.rlike(_PLACEHOLDER)),
        flag(F.lower(before).rlike(_CUE)),
        flag(F.lower(before).rlike(_ANTI)),
        flag(before.rlike(r"[=:]>?\s*[\"']?$")),
        flag(core.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_]|\(|\[|->|::)|^[$<{%]|^(?:None|null|nil|true|false|undefined)$")),
        flag(F.lower(path).rlike(_TEST_PATH)),
        flag(F.lower(path).rlike(_LIVE_PATH)),
        flag(core.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk_live|sk-|AIza|eyJ|glpat-|npm_)")),
        _part(core, "[-_/]"),
    )


def labelled_findings(seed: int = 5, each: int = 25) -> list[dict]:
    """Labelled findings (core, before, path, y), made by rule: `each` of every kind."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up_, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64, up, alnum = "0123456789abcdef", up_ + low + digit + "+/", up_ + digit, up_ + low + digit
    words = lambda n, glue="": glue.join(r.choice(DICTIONARY) for _ in range(n))
    say = lambda n: pick(["a", "e", "i", "o", "u", "ai", "ou"], 1).join(pick("bcdfghklmnprstvwz", 1) for _ in range(n))
    cues = ['token = "', 'api_key: "', "secret=", "password = '", "Authorization: Bearer ", "aws_secret_access_key = ", 'auth_token: "', "the access token is ", "private key: ", "PASSWORD=", "db_pwd: "]
    set_ = [c for c in cues if c.rstrip("\"' ")[-1] in "=:"]
    prose = ["and then the ", "it was said that ", "", "of a ", "with the name of ", "see the ", "und das ist ", "c'est la "]
    paths = ["src/app/main.py", "deploy/.env", "config/settings.yml", "web/page.html", "notes/today.txt", "lib/client.go", ""]
    tests = ["tests/fixtures/a.json", "docs/example.md", "sample/test_keys.py"]
    camel = lambda: "".join(r.choice(DICTIONARY).title() for _ in range(r.randint(3, 5)))
    kinds = [
        (1, lambda: (pick(hexa, r.choice([32, 40, 64])), r.choice(cues), r.choice(paths))),
        (1, lambda: (pick(hexa, r.choice([32, 40])), r.choice(cues), r.choice(paths))),
        (1, lambda: (pick(["AKIA", "ASIA"], 1) + pick(up, 16), r.choice([*cues, *prose]), r.choice(paths))),
        (1, lambda: (pick(["ghp_", "gho_", "glpat-", "sk_live_"], 1) + pick(alnum, r.randint(24, 36)), r.choice([*cues, *prose]), r.choice(paths))),
        (1, lambda: (pick(b64, r.choice([40, 44, 64])), r.choice(cues), r.choice(paths))),
        (1, lambda: (pick(alnum, r.randint(20, 48)), r.choice(cues), r.choice(paths))),
        (1, lambda: ("eyJ" + pick(alnum, 60), r.choice(cues), r.choice(paths))),
        (1, lambda: (_password(r), r.choice(set_), r.choice(paths))),
        (1, lambda: (say(r.randint(3, 5)) + pick(digit, r.randint(1, 4)) + pick("!@#.", r.randint(0, 1)), r.choice(set_), r.choice(paths))),
        (0, lambda: (pick(hexa, 40), r.choice(["commit ", "sha1: ", "revision ", "sha256 checksum ", "md5 hash of it is ", "etag: "]), r.choice(paths))),
        (0, lambda: ("-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), r.choice(["uuid: ", "id = ", "guid ", "request "]), r.choice(paths))),
        (0, lambda: (say(r.randint(8, 20)), r.choice([*prose, *prose, *cues]), r.choice(paths))),
        (0, lambda: (say(r.randint(8, 14)).title(), r.choice(prose), r.choice(paths))),
        (0, lambda: (camel(), r.choice([*prose, *cues, "new "]), r.choice(paths))),
        (0, lambda: (words(r.randint(3, 5), "_"), r.choice([*prose, *cues]), r.choice(paths))),
        (0, lambda: (words(r.randint(3, 6), "/"), r.choice(["src=", "path: ", *prose]), r.choice(paths))),
        (0, lambda: (r.choice(["x" * 24, "0" * 20, "your_api_key_goes_here", "1234567890abcdef1234", "changeme_changeme_now", "A" * 32, "changeme", "xxxxxx", "your-password", "********"]), r.choice(cues), r.choice(paths))),
        (0, lambda: (pick(hexa, 40), r.choice(['token = "', "example key: "]), r.choice(tests))),
        (0, lambda: (pick(alnum, 32), r.choice(["example token ", "dummy secret: ", "test password = "]), r.choice(tests))),
        (0, lambda: (pick(digit, r.randint(16, 20)), r.choice([*prose, "number ", "card "]), r.choice(paths))),
        (0, lambda: (r.choice("-=_") * r.randint(16, 60), "", r.choice(paths))),
        (0, lambda: (r.choice(["None", "null", "string", "true", "required", "optional", "hidden", "str", "bytes", "text", words(1), words(1)]), r.choice(set_), r.choice(paths))),
        (0, lambda: (r.choice([f"{words(1)}.{words(1)}", f"get_{words(1)}()", f"${{{words(1)}}}", f"os.environ[{words(1)}", f"${words(1).upper()}", f"<{words(1)}>", f"{words(1)}({words(1)})", f"{words(1)}->{words(1)}"]), r.choice(set_), r.choice(paths))),
        (0, lambda: (_password(r), r.choice(["test password = '", "dummy secret: ", "example token = "]), r.choice(tests))),
    ]
    return [dict(zip(("core", "before", "path"), make(), strict=True), y=y) for y, make in kinds for _ in range(each)]


def _password(r: random.Random) -> str:
    """A short password of letters, digits and maybe other characters, in any order."""
    chars = [*r.choices("abcdefghijkmnopqrstuvwxyz", k=r.randint(2, 6)), *r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ", k=r.randint(1, 3)), *r.choices("0123456789", k=r.randint(1, 4)), *r.choices("!@#$%&*.?", k=r.randint(0, 2))]
    r.shuffle(chars)
    return "".join(chars)


def train_forest(spark: SparkSession, findings: list[dict] | None = None, trees: int = 15, depth: int = 7, seed: int = 1) -> list:
    """A forest from labelled findings; their features are computed by the expressions that scanning uses."""
    rows = findings if findings is not None else labelled_findings()
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<core:string,before:string,path:string,y:int>>")))
    got = table.select("y", candidate_features(F.col("core"), F.col("before"), F.col("path")).alias("x")).collect()
    return grow_forest([tuple(r["x"]) for r in got], [r["y"] for r in got], trees, depth, seed)


def scan_secrets(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5, context: int = 3) -> DataFrame:
    """(id, n_candidates long, secrets array<struct<word, value, score>>, n_secrets long), a row for each row of docs.

    word numbers the text's words (parted by ASCII white space) from 0. A word may hold several candidates. The forest
    sees up to `context` words in front of a candidate and what stands before it in its own word; the second of two
    candidates in a word has its own context. Null, empty and wordless texts have none; without path_col, or where it is
    null, the path is empty. Repeated rows each return a row, an empty table none. Other columns are not read.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), path.alias("_path"))
    # Words first become a column of their own: lambdas below reach into it by place.
    words = src.select("_id", "_path", F.split(F.trim(F.regexp_replace("_t", _WS, " ")), " ").alias("_w"))

    def found(i: Column) -> Column:
        w = F.get(F.col("_w"), i)
        front = F.array_join(F.slice(F.col("_w"), F.greatest(i - context + 1, F.lit(1)), F.least(i, F.lit(context))), " ")
        # Between its candidates a word falls into pieces: the one at a candidate's place is what precedes it.
        pieces = F.split(w, CANDIDATE, -1)
        long_ = F.transform(F.regexp_extract_all(w, F.lit(CANDIDATE), 0), lambda c, k: F.struct(i.alias("word"), c.alias("core"), F.concat(front, F.lit(" "), F.get(pieces, k)).alias("before")))
        inside = F.regexp_extract(w, _WITHIN, 2)
        after = F.when(F.lower(front).rlike(_ASSIGN), F.regexp_extract(w, _VALUE, 1)).otherwise(F.lit(""))
        given = F.when(inside != "", F.struct(i.alias("word"), inside.alias("core"), F.concat(front, F.lit(" "), F.regexp_extract(w, _WITHIN, 1)).alias("before"))).when(after != "", F.struct(i.alias("word"), after.alias("core"), F.concat(front, F.lit(" ")).alias("before")))
        # A value that is a long run, or holds one, is that run's candidate.
        return F.when(F.size(long_) > 0, long_).otherwise(F.filter(F.array(given), lambda g: g.isNotNull()))

    ends = lambda w: F.right(w, F.lit(2)).rlike("[=:>\"']$")
    told = lambda w, i: w.rlike(r"[=:].") | (i > 0) & ends(F.get(F.col("_w"), i - 1))
    at = F.filter(F.transform(F.col("_w"), lambda w, i: F.when((F.length(w) >= 16) & w.rlike(CANDIDATE) | (F.length(w) >= 4) & told(w, i), i)), lambda i: i.isNotNull())
    cands = words.select("_id", F.transform(F.flatten(F.transform(at, found)), lambda c: F.struct(c["word"].alias("word"), c["core"].alias("core"), candidate_features(c["core"], c["before"], F.col("_path")).alias("x"))).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct(c["word"].alias("word"), c["core"].alias("value"), forest_column(forest, lambda k: F.get(c["x"], F.lit(k))).alias("score")))
    out = cands.select("_id", F.size("_c").cast("long").alias("n_candidates"), F.filter(scored, lambda c: c["score"] >= threshold).alias("secrets"))
    return out.select(F.col("_id").alias(id_col), "n_candidates", "secrets", F.size("secrets").cast("long").alias("n_secrets"))
