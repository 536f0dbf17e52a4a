"""Secret scans: candidate strings judged by a random forest, in SQL functions only.

Long mixed runs of token characters are candidates, and so are values of six or more characters that
are assigned to or quoted after a word such as password or key, passwords in addresses, bodies of private keys and signed
tokens of several parts. A forest of decision trees,
trained from labelled findings, tells keys and tokens from identifiers, numbers,
digests, paths and placeholders. It looks at a candidate's length, its beginning, its character
transitions, how much of it a small dictionary covers, its path and the words
beside it. The trees become CASE expressions, so that a scan is one projection.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._store import small

_RUN = "A-Za-z0-9_+/\\-"
MASK = "[SECRET]"
FRAGMENTS = (
    "access account address alpha api app article assets auth base beta blog build cache card category cdn channel client cloud code com commit config content "
    "contract count css customer data date debug default demo deploy dev device doc domain draft dummy edit email encode end entry error example export field file "
    "final font form format global group guest header home host html http image img import index info input invoice item java javascript job json key label lang "
    "last level lib link list local log login main map media member menu message meta method mobile mode model module name net news node note null number object "
    "offer option order org page param part password path photo php place plan post price product profile project public query queue rate read record release "
    "report request reset result review sample script search section secret select server service session set shop site size sort source spec start state static "
    "status stock store string style summary support system table tag task team temp template test text theme thread ticket time title token topic track type "
    "update upload user value version video view web word work write xml your"
).split()
HOLDERS = "token|secret|passw(?:or)?d|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|client.?key|key"
# the sign before a value is looked at first: it is cheap, and few places have one
_NAME, _SIGN = f"(?i:{HOLDERS})[\\w\\-]{{0,16}}[\"']?\\]?", "\\s{0,3}(?::=|=>|==|[:=])\\s{0,3}"
_QUOTED = f"(?<=[\"'`])(?<={_NAME}(?:{_SIGN}|\\s{{1,3}}|\\s{{1,3}}is\\s{{1,3}})[\"'`])[^\\s\"'`]{{6,}}(?=[\"'`])"
_BARE = f"(?<=[:=>\\s])(?<=[:=>]\\s{{0,3}})(?<={_NAME}{_SIGN})(?![:=>])(?:(?!&\\w+=)[^\\s\"'`,;<>(){{}}\\[\\]]){{5,}}(?<=[^\\s.,:;!?])"
_USER = "(?<=:)(?<=://[^\\s:/@]{1,64}:)[^\\s@/]{6,}(?=@)"
_ARMOURED = "(?<=PRIVATE KEY-----)[\\sA-Za-z0-9+/=]{16,}(?=-----END)"
_SIGNED = "(?<![\\w.\\-])(?:eyJ[\\w\\-]{8,}\\.eyJ[\\w\\-]{8,}\\.[\\w\\-]+|SG\\.[\\w\\-]{16,}\\.[\\w\\-]{16,})"
CANDIDATE = f"(?:{_ARMOURED}|{_SIGNED}|{_QUOTED}|{_BARE}|{_USER}|(?<![{_RUN}])(?=[A-Za-z_+/\\-]*[0-9])[{_RUN}]{{16,}}={{0,2}})"
# How tokens of well-known issuers begin.
ISSUED = "gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AKIA|ASIA|AIza|npm_|SG\\.|eyJ"
OTHERS = "sha-?(?:1|256|512)|md5|checksum|digest|hash|commit|revision|etag|uuid|guid|card|order|invoice|phone|tel|isbn|tracking|serial|version|build|id|ref|page|doi"
FEATURES = (
    "length", "transitions", "distinct", "digits", "uppers", "punctuation", "hexadecimal", "numeric", "dictionary",
    "in_path", "path_names", "placeholder", "holder_near", "holder_at", "other_at", "assigned", "quoted",
    "signs", "user_at", "called", "issued", "armoured",
)


def features(token: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES as doubles. ``before`` and ``after`` are the text beside the candidate."""
    low, near = F.lower(token), F.lower(before)
    n = F.char_length(token).cast("double")
    rate = lambda pattern: F.size(F.regexp_extract_all(token, F.lit(pattern), F.lit(0))) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": n,
        "transitions": rate("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / n,
        "digits": rate("[0-9]"),
        "uppers": rate("[A-Z]"),
        "punctuation": rate("[_+/=\\-]"),
        "hexadecimal": flag(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(token.rlike("^[0-9+\\-=/]+$")),
        "dictionary": (n - F.char_length(F.regexp_replace(low, "|".join(sorted(FRAGMENTS, key=len, reverse=True)), ""))) / n,
        "in_path": flag(before.rlike("[/.\\\\]$") | after.rlike("^[./\\\\]\\w") | near.rlike("https?:\\S*$")),
        "path_names": flag(F.lower(path).rlike("test|example|sample|fixture|mock|doc")),
        "placeholder": flag(low.rlike("x{6}|0{8}|1234567|abcdef|example|your|dummy|placeholder|(.)\\1{5}")),
        "holder_near": flag(near.rlike(f"(?:{HOLDERS})")),
        "holder_at": flag(near.rlike(f"(?:{HOLDERS})[\\w\\-]*[\"']?\\s*(?:[:=]+|=>|is)?\\s*[\"'`]?$")),
        "other_at": flag(near.rlike(f"\\b(?:{OTHERS})[\"']?\\s*(?:[:=#.]|no|nr|is)*\\s*[\"'`(]?$")),
        "assigned": flag(before.rlike("[:=]\\s*[\"'`]?$")),
        "signs": rate("[^A-Za-z0-9_+/=\\-]"),
        "user_at": flag(before.rlike("://[^\\s:/@]+:$") & after.rlike("^@")),
        "issued": flag(token.rlike(f"^(?:{ISSUED})")),
        "armoured": flag(before.rlike("PRIVATE KEY-----$")),
        "called": flag(after.rlike("^[(\\[{]") | token.rlike("^[$%]?[A-Za-z_]+(?:\\.[A-Za-z_]+)+$|://")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
    }
    return F.struct(*(made[f].cast("double").alias(f) for f in FEATURES))


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Findings (before, token, after, path, label): true keys beside the usual false alarms."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, mixed = digit + "abcdef", lower + upper + digit
    prose = lambda: " ".join(pick(lower, r.randint(2, 9)) for _ in range(r.randint(0, 6)))
    holders = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "API-KEY", "bearer"]
    others = ["sha1", "sha256", "md5", "checksum", "commit", "etag", "uuid", "card", "order", "invoice", "tracking", "serial", "id", "ref", "phone"]
    live, other = ["src/app.py", "conf/prod.yml", "", "", ""], ["tests/test_app.py", "docs/example.md", "fixtures/a.json", "", "src/app.py", ""]
    # a sign that any digit is present keeps made-up findings among the candidates of a scan
    sure = lambda s: s if any(c in digit for c in s) else s[:-1] + r.choice(digit)

    def key() -> str:
        kind = r.random()
        body = pick(hexa, r.choice([32, 40, 40, 48, 64])) if kind < 0.5 else pick(mixed, r.randint(20, 48)) if kind < 0.8 else r.choice(["sk_live_", "ghp_", "xoxb-", "AKIA"]) + pick(mixed, r.randint(16, 36))
        return sure(body.upper() if r.random() < 0.15 else body)

    def issued() -> tuple[str, bool]:
        kind, fake = r.randrange(5), r.random() < 0.2
        body = lambda k: r.choice(["x", "0", "X"]) * k if fake else sure(pick(mixed, k))
        if kind == 0:
            return r.choice(["ghp_", "gho_", "ghs_", "glpat-", "npm_"]) + body(r.choice([20, 36])), not fake
        if kind == 1:
            return r.choice(["AKIA", "ASIA"]) + (r.choice(["EXAMPLE000000000", "XXXXXXXXXXXXXXX0"]) if fake else sure(pick(upper + digit, 16))), not fake
        if kind == 2:
            return r.choice(["sk_live_", "rk_live_", "AIza"]) + body(r.randint(24, 35)), not fake
        if kind == 3:
            return f"xox{r.choice('abp')}-{pick(digit, 12)}-{body(24)}", not fake
        return ".".join(["eyJ" + pick(mixed, r.randint(16, 30)), "eyJ" + pick(mixed, r.randint(20, 60)), pick(mixed + "_-", 43)]), True

    def innocent() -> str:
        kind = r.randrange(8)
        if kind == 0:
            return pick(digit, r.randint(16, 20))
        if kind == 1:
            return "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 2:
            return r.choice("-_").join([*r.sample(FRAGMENTS, r.randint(2, 5)), pick(digit, r.randint(2, 8))])
        if kind == 3:
            return "/".join([*r.sample(FRAGMENTS, r.randint(2, 4)), pick(digit, r.randint(4, 8))])
        if kind == 4:
            return pick(lower, r.randint(14, 24)) + pick(digit, r.randint(2, 4))
        if kind == 5:
            return "-".join(pick(digit, 4) for _ in range(r.randint(4, 6)))
        return pick(hexa, r.choice([32, 40, 64]))

    out = []
    for _ in range(n):
        lead, tail = prose(), prose()
        if r.random() < 0.12:
            # a token of a known issuer is one wherever it stands, unless it is a placeholder
            token, true = issued()
            opening, closing = r.choice([("", ""), ("(", ")"), ('"', '"'), ("`", "`")])
            out.append((f"{lead} {r.choice(['', 'use ', 'id: ', 'the '])}{opening}", token, f"{closing} {tail}", r.choice(live if true else other), int(true)))
            continue
        if r.random() < 0.04:
            out.append((f"{lead} -----BEGIN {r.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----", "\n" + "\n".join(pick(mixed + "+/", 64) for _ in range(r.randint(1, 12))) + "\n", "-----END ", r.choice(live), 1))
            continue
        path = r.choice(other)
        if r.random() < 0.45:
            path = r.choice(live)
            quote = r.choice(['"', '"', "'", ""])
            name = r.choice(holders)
            name = name.upper() if r.random() < 0.2 else name
            out.append((f"{lead} {name}{r.choice([' = ', '=', ': ', ':', ' '])}{quote}", key(), f"{quote} {tail}", path, 1))
        elif r.random() < 0.2:
            quote = r.choice(['"', "'", ""])
            fake = r.choice(["your-token-here-1234567", "xxxxxxxxxxxxxxxx0000", "example_key_0123456789", "0" * 32, "abcdef0123456789abcdef"])
            out.append((f"{lead} {r.choice(holders)}{r.choice([' = ', ': '])}{quote}", fake, f"{quote} {tail}", path, 0))
        else:
            named = r.random() < 0.6
            quote = r.choice(['"', "", ""])
            before = f"{lead} {r.choice(others)}{r.choice([' ', ': ', ' = ', ' #'])}{quote}" if named else f"{lead} {r.choice(['', 'https://a.example/', '/', '('])}"
            out.append((before, sure(innocent()), f"{quote if named else ''} {tail}", path, 0))
    return out + assigned_findings(n // 2, r)


def assigned_findings(n: int, r: random.Random) -> list[tuple[str, str, str, str, int]]:
    """Values after a holder's name: passwords of any length and signs, and the words, names and calls that stand there."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: r.choice(FRAGMENTS)
    holders = ["password", "passwd", "pwd", "secret", "api_key", "db_password", "token", "auth_token", "client_secret", "PASSWORD", "Password"]

    def password() -> str:
        kind = r.random()
        if kind < 0.15:
            return pick(lower + upper + digit, r.randint(7, 15))
        if kind < 0.3:
            return pick(lower, r.randint(4, 7)) + pick(digit, r.randint(1, 4)) + pick(lower, r.randint(0, 5))
        if kind < 0.6:
            return pick(lower + upper, r.randint(1, 4)) + r.choice(".!@:$#%^*?~") + pick(lower + upper + digit + ".!@$#%^*?", r.randint(4, 12))
        if kind < 0.8:
            return pick(upper, 1) + pick(lower, r.randint(1, 4)) + pick(digit, r.randint(1, 3)) + pick(lower + digit, r.randint(2, 6)) + r.choice(["", "!", "$"])
        return pick(lower + upper, r.randint(16, 40))

    def plain() -> tuple[str, str]:
        kind = r.randrange(6)
        if kind == 0:
            return pick(lower, r.randint(6, 12)), ""
        if kind == 1:
            return word() + r.choice(["", "s", "_", "-"]) + word(), ""
        if kind == 2:
            return ".".join([word(), word(), *([word()] if r.random() < 0.5 else [])]), r.choice(["", "(", "["])
        if kind == 3:
            return r.choice(["********", "xxxxxxxx", "changeme-example", "your-password", "example", "placeholder", "00000000", "$PASSWORD", "%PASSWORD%"]), ""
        if kind == 4:
            return "https://" + pick(lower, 6) + "." + word() + "/" + word(), ""
        return r.choice(["required", "optional", "undefined", "invalid", "missing", "expired", "string", "getpass", "Required", "None/null", "disabled", "default"]), ""

    out = []
    for _ in range(n):
        lead, path = " ".join(pick(lower, r.randint(2, 9)) for _ in range(r.randint(0, 6))), r.choice(["src/app.py", "conf/prod.yml", "", "", ""])
        quote, name = r.choice(['"', '"', "'", ""]), r.choice(holders)
        before = f"{lead} {name}{r.choice([' = ', '=', ': ', ':'])}{quote}"
        if r.random() < 0.2:
            secret = r.random() < 0.9
            out.append((f"{lead} {r.choice(['postgres', 'https', 'mysql', 'ftp'])}://{pick(lower, 5)}:", password() if secret else "password", f"@{pick(lower, 6)}.example/", path, int(secret)))
        elif r.random() < 0.5:
            out.append((before, password(), f"{quote} {word()}", path, 1))
        else:
            value, after = plain()
            out.append((before, value, after or f"{quote} {word()}", path, 0))
    return out


@dataclass(frozen=True)
class Node:
    feature: int
    bound: float
    low: Node | float
    high: Node | float


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 21, depth: int = 7, least: int = 4, seed: int = 5) -> list[Node | float]:
    """Trees on bootstrap samples, each split on the best of a random few features by Gini impurity."""
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33))) for f in range(x.shape[1])]
    some = max(1, round(x.shape[1] ** 0.5))

    def grow(rows: np.ndarray, deep: int) -> Node | float:
        mean = float(y[rows].mean())
        if deep == 0 or len(rows) < 2 * least or mean in (0.0, 1.0):
            return mean
        best = (mean * (1 - mean) * len(rows) - 1e-9, -1, 0.0)
        for f in r.choice(x.shape[1], some, replace=False):
            for c in (cuts[f][1:] + cuts[f][:-1]) / 2:
                low = x[rows, f] <= c
                a = int(low.sum())
                if least <= a <= len(rows) - least:
                    p, q = y[rows][low].mean(), y[rows][~low].mean()
                    worse = a * p * (1 - p) + (len(rows) - a) * q * (1 - q)
                    if worse < best[0]:
                        best = (worse, int(f), float(c))
        if best[1] < 0:
            return mean
        low = x[rows, best[1]] <= best[2]
        return Node(best[1], best[2], grow(rows[low], deep - 1), grow(rows[~low], deep - 1))

    return [grow(r.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest_score(x: Column, forest: Sequence[Node | float]) -> Column:
    """Mean of the trees' leaves as a CASE expression on a struct of FEATURES."""

    def case(node: Node | float) -> Column:
        if not isinstance(node, Node):
            return F.lit(round(node, 6))
        return F.when(x[FEATURES[node.feature]] <= F.lit(node.bound), case(node.low)).otherwise(case(node.high))

    return reduce(lambda a, b: a + b, map(case, forest)) / F.lit(float(len(forest)))


def train_forest(spark: SparkSession, findings: Sequence[tuple[str, str, str, str, int]] | None = None) -> list[Node | float]:
    rows = small(spark, [*(findings or labelled_findings())], "before string, token string, after string, path string, label int")
    made = rows.select("label", features(F.col("token"), F.col("before"), F.col("after"), F.col("path")).alias("x")).select("label", *(F.col("x")[f].alias(f) for f in FEATURES)).collect()
    x = np.array([[r[f] for f in FEATURES] for r in made])
    return grow_forest(x, np.array([r["label"] for r in made], float))


def scan_secrets(docs: DataFrame, path: str | None = None, cut: float = 0.5, forest: Sequence[Node | float] | None = None) -> DataFrame:
    """Add to ``docs(..., text, ...)`` the columns n_candidates, findings and redacted.

    ``findings`` is an array of (start, length, score) of the secrets, in characters from 0; in
    ``redacted`` each is replaced by a mask and all else is as before. All other columns stay, whatever
    their names; of columns named n_candidates, findings or redacted the new one wins. Null text has no candidates and stays null. Texts
    without candidates stay as they are; very long ones are scanned whole. Repeated rows are scanned alike. An empty table gives an empty
    result. ``path`` names a column with each text's file path, if there is one.
    """
    forest = forest or train_forest(docs.sparkSession)
    taken = {c.lower() for c in docs.columns}
    lead = next("_" * i for i in range(1, len(taken) + 2) if not any(c.startswith("_" * i) for c in taken))
    own = {c: lead + c for c in ("tokens", "between", "x", "score")}  # names that no column of docs has
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    some = text.rlike("[0-9:=\"'`]")  # no candidate is without one of these
    out = docs.withColumn(own["tokens"], F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    found = F.size(own["tokens"]) > 0
    out = out.withColumn(own["between"], F.when(found, F.split(text, CANDIDATE, -1)).otherwise(none))
    where = F.col(path) if path else F.lit("")
    judged = F.transform(own["tokens"], lambda t, i: features(t, F.right(F.get(own["between"], i), F.lit(48)), F.left(F.get(own["between"], i + 1), F.lit(16)), where))
    out = out.withColumn(own["x"], judged)
    out = out.withColumn(own["score"], F.transform(own["x"], lambda x: forest_score(x, forest)))
    step = lambda a, i: F.struct(
        (a["at"] + F.char_length(F.get(own["between"], i)) + F.char_length(F.get(own["tokens"], i))).alias("at"),
        F.concat(a["all"], F.array(F.struct((a["at"] + F.char_length(F.get(own["between"], i))).alias("start"), F.char_length(F.get(own["tokens"], i)).alias("length"), F.get(own["score"], i).alias("score")))).alias("all"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,score:double>>").alias("all"))
    every = F.when(found, F.aggregate(F.sequence(F.lit(0), F.size(own["tokens"]) - 1), zero, step, lambda a: a["all"])).otherwise(F.array().cast("array<struct<start:int,length:int,score:double>>"))
    pieces = F.transform(own["tokens"], lambda t, i: F.concat(F.when(F.get(own["score"], i) >= cut, F.lit(MASK)).otherwise(t), F.get(own["between"], i + 1)))
    hit = F.exists(own["score"], lambda s: s >= cut)
    out = out.withColumn("redacted", F.when(hit, F.concat(F.get(own["between"], F.lit(0)), F.array_join(pieces, ""))).otherwise(F.col("text")))
    out = out.withColumn("n_candidates", F.size(own["tokens"]).cast("long")).withColumn("findings", F.filter(every, lambda f: f["score"] >= cut))
    return out.drop(*own.values())
