"""Secret scans: candidates by pattern, and a random forest that tells secrets from what only looks like one."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, named, text_slices
from .op02_packing import vocabulary

#: A run that could be a credential, and key blocks.
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Characters looked at before and behind a candidate.
AROUND = 40
THRESHOLD = 0.5
TREES, DEPTH, LEAF = 40, 10, 4
#: The bound of the labelled findings that a forest is fitted on.
FINDINGS = 7500

GOOD_WORDS = ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "access", "private", "pwd", "client_secret")
BAD_WORDS = ("sha", "sha1", "sha256", "md5", "hash", "commit", "checksum", "digest", "uuid", "guid", "etag", "revision", "example", "sample", "dummy", "placeholder", "integrity", "version", "id", "isbn", "path", "file", "url", "image")
#: What a name with a credential word is set to, in quotes or up to white space, whatever its length and characters.
ASSIGNED = re.compile(r"(?:" + "|".join(GOOD_WORDS) + r""")\w{0,64}["'`]?[ \t]*(?:=>|:=|=|:)[ \t]*(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`|([^\s"'`,;({\[<]*[({\[<][^\s"'`,;]*[^\s"'`,;.]|[^\s"'`,;]*[^\s"'`,;.)\]}>]))""", re.IGNORECASE)
#: The password of a connection string, and what follows an option with a credential word.
URL = re.compile(r"""://[^\s:/@"'`]*:([^\s@/"'`]+)@(?=[A-Za-z0-9\[])""")
FLAG = re.compile(r"(?<![\w-])--?(?:[a-z]+[-_])*(?:" + "|".join(GOOD_WORDS) + r""")[ \t]+([^\s"'`;|&-][^\s"'`;|&]*)""", re.IGNORECASE)
NEAR_WORDS = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


@lru_cache(maxsize=1)
def dictionary() -> frozenset[str]:
    """Letter pieces of at least three characters of a public vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(k).lstrip("▁").lower() for k in range(model.get_piece_size()))
    return frozenset(p for p in pieces if len(p) >= 3 and p.isascii() and p.isalpha())


@lru_cache(maxsize=1)
def by_head() -> dict[str, list[str]]:
    """The dictionary's words by their first three letters, the longest first."""
    out: dict[str, list[str]] = {}
    for word in sorted(dictionary(), key=lambda w: (-len(w), w)):
        out.setdefault(word[:3], []).append(word)
    return out


def coverage(value: str) -> float:
    """The share of the characters that dictionary words without overlap cover, the longest first at each place."""
    value, heads, at, covered = value.lower(), by_head(), 0, 0
    while at < len(value):
        for word in heads.get(value[at : at + 3], ()):
            if value.startswith(word, at):
                covered += len(word)
                at += len(word)
                break
        else:
            at += 1
    return covered / max(1, len(value))


def kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3


def features(before: str, value: str, after: str) -> list[float]:
    """Length, character shares and transitions, entropy, dictionary coverage, path signs, neighbouring words."""
    n, block = len(value), value.startswith("-----BEGIN") and value.count("-----") > 2
    kinds = [kind(c) for c in value]
    count = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    moves = Counter(zip(kinds, kinds[1:]))
    bigrams = len(set(zip(value, value[1:]))) / max(1, n - 1)
    near = [w.lower() for w in NEAR_WORDS.findall(before[-AROUND:])][-3:]
    left = before[-1:]
    tail = before[-4:].rstrip("\"' ")
    return [
        math.log2(n),
        *(kinds.count(k) / n for k in range(4)),
        sum(c in "0123456789abcdef" for c in value) / n,
        entropy,
        entropy / math.log2(max(2, n)),
        bigrams,
        max(count.values()) / n,
        *(moves[a, b] / max(1, n - 1) for a in range(3) for b in range(3) if a != b),
        sum(kinds[k] != kinds[k + 1] for k in range(n - 1)) / max(1, n - 1),
        coverage(value.split("-----")[2] if block else value),
        float(value.count("/")),
        float(value.count("-")),
        float(value.count("_")),
        float(left in "/.\\#" and left != ""),
        float(after[:1] in "/.\\" and after != ""),
        float(left in "\"'`" and left != ""),
        float(after[:1] in "\"'`" and after != ""),
        float(tail[-1:] in "=:" and tail != ""),
        float(any(w in GOOD_WORDS for w in near)),
        float(bool(near) and any(g in near[-1] for g in GOOD_WORDS)),
        float(any(w in BAD_WORDS for w in near)),
        float("://" in before[-AROUND:] and " " not in before[-AROUND:].rpartition("://")[2]),
        float("://" in before[-AROUND:] and left == ":" and after[:1] == "@"),
        float(block),
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate, in order; they may overlap.

    Candidates are private key blocks, runs of 16 or more letters, digits and + / _ - outside them, and of any length and
    characters: what is assigned to a name with a credential word or follows such an option, and passwords in URLs.
    """
    out = {m.span() for m in BLOCK.finditer(text)} if "PRIVATE KEY" in text else set()
    blocks = sorted(out)
    out.update(m.span() for m in RUN.finditer(text))
    if blocks:
        out = {(a, b) for a, b in out if not any(p <= a and b <= q and (a, b) != (p, q) for p, q in blocks)}
    if "=" in text or ":" in text:
        out.update(m.span(m.lastindex) for m in ASSIGNED.finditer(text))
        out.update(m.span(1) for m in URL.finditer(text))
    if "-" in text:
        out.update(m.span(1) for m in FLAG.finditer(text))
    return sorted(out)


def candidates(text: str):
    """(start, end, features) of each candidate; features are of the whole value."""
    for a, b in spans(text):
        yield a, b, features(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])


class Forest:
    """Decision trees on bootstrap samples, each split the best of a random set of features; votes are averaged."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            tree: list[tuple] = []
            self._grow(tree, x[rows], y[rows], depth, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*tree)))

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        at, p = len(tree), float(y.mean())
        tree.append((-1, 0.0, 0, 0, p))
        if depth == 0 or len(y) < 2 * LEAF or p in (0.0, 1.0):
            return at
        best = (1e9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            k = np.arange(LEAF, len(y) - LEAF + 1)
            k = k[v[k - 1] < v[np.minimum(k, len(v) - 1)]]
            if not len(k):
                continue
            left, right = hits[k - 1], hits[-1] - hits[k - 1]
            impurity = left * (1 - left / k) + right * (1 - right / (len(y) - k))
            j = int(impurity.argmin())
            if impurity[j] < best[0]:
                low, high = float(v[k[j] - 1]), float(v[k[j]])
                best = (float(impurity[j]), int(f), low if (low + high) / 2 >= high else (low + high) / 2)
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        low = self._grow(tree, x[go], y[go], depth - 1, rng)
        high = self._grow(tree, x[~go], y[~go], depth - 1, rng)
        tree[at] = (best[1], best[2], low, high, p)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, low, high, p in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], low[node], high[node])
            total += p[at]
        return total / len(self.trees)


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, bool]]:
    """Labelled findings (before, value, behind, is a secret) in the formats that scanners report; n is their bound."""
    make = Findings(seed)
    out: list[tuple[str, str, str, bool]] = []
    while len(out) < n:
        for family in (make.token, make.password, make.block):
            out += family()
    return out[:n]


class Findings:
    """Makes labelled findings; each family gives a secret and something that looks like one."""

    HEX, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
    BASE64, MIXED = ALNUM + "+/", ALNUM + "!@#$%^&*?+-_.~"
    FILLERS = ["None", "null", "true", "false", "nil", "undefined", "required", "optional", "string", "str", "int", "bytes"]
    STAND_INS = ["changeme", "example", "placeholder", "secret", "password", "test", "dummy", "todo"]
    CALLS = ["os.environ[", "getenv(", "self.", "config.", "request.", "args.", "settings.get("]
    VARIABLES = ["${%s}", "{{%s}}", "<%s>", "$%s", "%%(%s)s", "{%s}"]

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = sorted(dictionary())

    def one(self, *makers):
        return self.rng.choice(makers)()

    def pick(self, letters: str, low: int, high: int | None = None) -> str:
        return "".join(self.rng.choices(letters, k=self.rng.randint(low, high or low)))

    def word(self) -> str:
        return self.rng.choice(self.words)

    def prose(self, n: int = 4) -> str:
        return " ".join(self.word() for _ in range(n))

    def invented(self) -> str:
        """A long word of no dictionary: pieces of others."""
        cut = lambda w, k: w[k : k + self.rng.randint(2, 4)]
        return "".join(cut(self.word(), self.rng.randint(0, 3)) for _ in range(self.rng.randint(6, 12)))

    def name(self) -> str:
        return self.rng.choice(["", "my_", "API_", "db_"]) + self.rng.choice(GOOD_WORDS)

    def assigned(self, value: str, secret: bool, quote: str) -> tuple[str, str, str, bool]:
        before = f"{self.prose()} {self.name()}" + self.rng.choice([" = ", "=", ": ", '": ']) + quote
        return before, value, quote + self.rng.choice([" ", "\n", ";"]) + self.prose(), secret

    def leet(self, word: str) -> str:
        return "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c) if self.rng.random() < 0.5 else c for c in word)

    def chosen_password(self) -> str:
        """A password as people choose them."""
        mark, digits, word = self.rng.choice("!@#$%^&*?+-_."), self.pick(string.digits, 1, 4), self.word
        return self.one(
            lambda: self.pick(self.MIXED, 6, 24),
            lambda: self.pick(self.ALNUM, 8, 24),
            lambda: self.leet(word()).capitalize() + mark + digits + self.rng.choice(["", "!"]),
            lambda: self.leet(word()).capitalize() + mark + self.leet(word()) + self.rng.choice("#!*") + word(),
            lambda: word() + word() + digits,
            lambda: word().capitalize() + self.rng.choice([digits + mark, mark + digits]),
            lambda: mark.join(word() for _ in range(3)) + digits,
            lambda: self.pick(string.ascii_lowercase, 8, 32),
            lambda: self.pick(string.ascii_uppercase, 16, 32),
        )

    def variable(self) -> str:
        case = self.rng.choice([str.lower, str.upper])
        return self.rng.choice(self.VARIABLES) % case(self.rng.choice(["", "db_", "my_"]) + self.rng.choice([self.word(), self.rng.choice(GOOD_WORDS)]))

    def no_password(self) -> str:
        return self.one(
            self.word,
            lambda: self.word().capitalize(),
            lambda: self.rng.choice(self.FILLERS),
            lambda: self.rng.choice(self.CALLS) + self.word(),
            self.variable,
            lambda: self.rng.choice("*x.X0-") * self.rng.randint(1, 14),
            lambda: self.rng.choice(["your", "my", "the", "new", "user"]) + self.rng.choice("-_ ") + self.rng.choice(GOOD_WORDS),
            lambda: self.rng.choice(self.STAND_INS),
            lambda: self.pick(string.digits, 1, 3),
            self.prose,
            lambda: "/" + "/".join(self.word() for _ in range(2)),
            lambda: self.word() + "_" + self.word(),
        )

    def password(self):
        value = self.no_password()
        quote = self.rng.choice(['"', "'"]) if " " in value or self.rng.random() < 0.3 else ""
        yield self.assigned(self.chosen_password(), True, self.rng.choice(['"', "'", ""]))
        yield self.assigned(value, False, quote)

    def token(self):
        upper = string.ascii_uppercase + string.digits
        value = self.one(
            lambda: self.pick(self.HEX, self.rng.choice([32, 40, 64])),
            lambda: self.pick(self.ALNUM, 20, 60),
            lambda: "AKIA" + self.pick(upper, 16),
            lambda: "ghp_" + self.pick(self.ALNUM, 36),
            lambda: "sk_live_" + self.pick(self.ALNUM, 24),
            lambda: self.pick(self.BASE64, self.rng.choice([40, 64])) + "=",
            lambda: "xoxb-" + self.pick(string.digits, 12) + "-" + self.pick(self.ALNUM, 24),
            lambda: "eyJ" + self.pick(self.ALNUM + "-_", 40, 120),
        )
        yield self.assigned(value, True, self.rng.choice(['"', "'", ""]))
        before, after = self.prose() + " ", " " + self.prose()
        stand_in = lambda: self.rng.choice(["your", "my", "insert", "example", "test"]) + self.rng.choice("-_") + self.rng.choice(["api", "secret", "auth"]) + self.rng.choice("-_") + self.rng.choice(["key", "token"]) + self.rng.choice(["-here", "_here", "_123", "-goes-here"])
        sums = ["commit ", "sha256:", "md5 = ", "checksum: ", "revision=", 'etag: "']
        before, value = self.one(
            lambda: (before + self.rng.choice(sums), self.pick(self.HEX, self.rng.choice([32, 40, 64]))),
            lambda: (before + self.rng.choice(["uuid ", "id: ", ""]), "-".join(self.pick(self.HEX, k) for k in (8, 4, 4, 4, 12))),
            lambda: (before, "".join(self.word().capitalize() for _ in range(self.rng.randint(3, 6)))),
            lambda: (before, "".join(self.word() for _ in range(self.rng.randint(3, 6)))),
            lambda: (before, self.invented()),
            lambda: (before[:-1] + ". ", self.invented().capitalize()),
            lambda: (self.prose() + self.rng.choice([" import ", " class ", " new ", " "]), "".join(self.invented()[:9].capitalize() for _ in range(self.rng.randint(2, 4)))),
            lambda: (before, "_".join(self.word() for _ in range(self.rng.randint(3, 6))) + self.rng.choice(["", "2", "_v1"])),
            lambda: (before + self.rng.choice(["/", "./", "https://host."]), "/".join(self.word() for _ in range(self.rng.randint(3, 6)))),
            lambda: (before + f'{self.rng.choice(GOOD_WORDS)} = "', stand_in()),
            lambda: (before + f"{self.rng.choice(GOOD_WORDS)}: ", self.rng.choice(["x", "0", "X", "a1"]) * self.rng.randint(10, 30) + self.pick(self.ALNUM, 2)),
            lambda: (before, self.pick(string.digits, 16, 20)),
            lambda: (before, self.rng.choice("-_=/+xX") * self.rng.randint(16, 80)),
            lambda: (before, self.rng.choice(["ab", "-=", "ha", "01"]) * self.rng.randint(8, 30)),
            lambda: (before, self.rng.choice(["", "THE"]).join(self.word().upper() for _ in range(4)) + self.pick(string.digits, 0, 3)),
        )
        yield before, value, after, False

    def block(self):
        """Key blocks, passwords in URLs and behind options; stand-ins for them, and lines of what is no private key."""
        kind = self.rng.choice(["", "RSA ", "EC ", "OPENSSH ", "DSA ", "ENCRYPTED "])
        framed = lambda body: f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
        lines = lambda low, high, break_="\n": break_.join(self.pick(self.BASE64, 64) for _ in range(self.rng.randint(low, high))) + break_ + self.pick(self.BASE64, 4, 60) + "=" * self.rng.randint(0, 2)
        headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + self.pick(self.HEX, 32) + "\n\n"
        before, after = self.prose() + self.rng.choice([" ", "\n", ': "']), self.rng.choice([" ", "\n"]) + self.prose()
        url = self.prose() + " " + self.rng.choice(["postgres", "mysql", "https", "amqp", "redis", "mongodb+srv"]) + "://" + self.rng.choice(["", "root", "admin", self.word()]) + ":"
        host = "@" + self.word() + self.rng.choice([".com/", ":5432/", ".internal/"]) + self.word()
        flag = self.prose() + " " + self.rng.choice(["--", "-", "--db-"]) + self.rng.choice(GOOD_WORDS) + " "
        yield self.one(
            lambda: (before, framed(lines(1, 26)), after, True),
            lambda: (before, framed(headers + lines(4, 20)), after, True),
            lambda: (before, framed(lines(1, 20, "\\n")), after, True),
            lambda: (before, framed(self.pick(self.rng.choice([self.HEX, "AB01", "QUFB", string.ascii_letters]), 60, 900)), after, True),
            lambda: (url, self.chosen_password(), host, True),
            lambda: (flag, self.chosen_password().lstrip("-"), after, True),
        )
        line = lambda: self.pick(self.BASE64, 64)
        stand_in = self.one(lambda: self.rng.choice(["...", "xxxx", "XXXXXXXX", "****", "[redacted]"]), lambda: "your " + self.prose(2) + " here", lambda: "YOUR PRIVATE KEY HERE", self.variable)
        yield self.one(
            lambda: (before, framed(stand_in), after, False),
            lambda: (line() + "\n", line(), "\n" + line(), False),
            lambda: ("-----BEGIN CERTIFICATE-----\n", line(), "\n" + line(), False),
            lambda: (self.prose(2) + " data:image/png;base64,", self.pick(self.BASE64, 60, 400), '" ' + self.prose(2), False),
            lambda: (url, self.one(lambda: self.rng.choice(self.STAND_INS), self.variable, lambda: self.rng.choice("*x") * self.rng.randint(3, 10)), host, False),
            lambda: (flag, self.one(lambda: self.rng.choice(self.STAND_INS), self.variable, self.word), after, False),
        )


def fit(findings: list[tuple[str, str, str, bool]]) -> Forest:
    x = np.array([features(b[-AROUND:], v, a[:AROUND]) for b, v, a, _ in findings])
    return Forest(x, np.array([float(y) for *_, y in findings]))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit(labelled_findings())


def scan_text(text: str, forest: Forest) -> list[tuple[int, int, float]]:
    found = list(candidates(text))
    if not found:
        return []
    return [(a, b, float(s)) for (a, b, _), s in zip(found, forest.predict(np.array([f for _, _, f in found])))]


def findings(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate (they may overlap): doc_id, start and length in characters, value_sha256, score, is_secret.

    score is the forest's vote; forest may be fitted on findings of one's own. A null or empty text has no candidate; a
    null doc_id is kept; repeated rows each give their rows; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for a, b, score in scan_text(text or "", shared.value):
                        rows.append((k, a, b - a, hashlib.sha256(text[a:b].encode()).hexdigest(), score, score >= threshold))
                if rows:
                    row, *columns = zip(*rows)
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "start", "length", "value_sha256", "score", "is_secret"])

    return named(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, value_sha256 string, score double, is_secret boolean")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame, forest: Forest | None = None, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all rows and columns, with each secret in text replaced by mark.

    n_chars, if there and a whole number, is counted anew for the changed texts; with another type it stays as it is. Null and
    empty texts, null doc_ids and other columns stay as they are; equal rows stay equal; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    names, place = docs.columns, docs.columns.index("text")
    counted = names.index("n_chars") if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, place):
                columns, changed = list(part.columns), {}
                for k, text in enumerate(part.column(place).to_pylist()):
                    found = [(a, b) for a, b, score in scan_text(text or "", shared.value) if score >= threshold]
                    for a, b in reversed(joined(found)):
                        changed[k] = text = text[:a] + mark + text[b:]
                for at, value in ((place, lambda t: t), (counted, len)):
                    if at is not None and changed:
                        column = columns[at].to_pylist()
                        for k, text in changed.items():
                            column[k] = value(text)
                        columns[at] = pa.array(column, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(documents(spark, sf_dir))
