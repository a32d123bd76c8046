"""Secrets in texts: wide candidate patterns, and a random forest that removes false positives.

Candidates are values with the shape of a credential, values assigned to a name,
and long runs of letters with digits. Each is described by its length, its
character transitions, how much of it dictionary words cover, the document's
path and the neighbouring words; a forest trained from labelled findings says
which are secrets. The forest has a fixed size and is broadcast; documents are
scanned whole where they lie. Dictionary words are those of a public vocabulary
file, which workers read themselves.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache
from .word_encoder import vocabulary

# Public shapes of credentials, by kind.
SHAPES = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\Z)",
    "aws_key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9-]{10,}",
    "json_web_token": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "live_key": r"(?<![A-Za-z0-9])[srp]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35,}",
}
_SHAPED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SHAPES.items()), re.S)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
_ASSIGN = re.compile(r"[=:]")
_NAME = re.compile(r"([A-Za-z][\w.-]{1,40})[\"']?\s{0,3}:?$")
#: A value, to its closing quote where it has one and no blanks; else to a blank, quote, comma or bracket.
_VALUE = re.compile(r""">?\s*(?:(?i:bearer|basic|token)[^\S\n]+)?(?:"(?P<double>(?:\\.|[^\s"\\]){6,})(?=")|'(?P<single>(?:\\.|[^\s'\\]){6,})(?=')|["']?(?P<bare>[^\s"'<>,;()]{6,}))""")
#: Values that no sign assigns: passwords and tokens of URLs, bearer values with a digit, texts of elements.
_USER_INFO = re.compile(r"://(?:[^\s/:@\"'<>]*:)?([^\s/\"'<>]{6,})@(?=[^\s@])")
_BEARER = re.compile(r"(?<![A-Za-z])bearer[^\S\n]+(?=[^\s\d]*\d)([\w.~+/-]{6,}=*)", re.I)
_ELEMENT = re.compile(r"<([A-Za-z][\w.:-]*)(?:\s[^<>]*)?>\s*([^\s<>]{6,})\s*</")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Names and words that go with secrets, and with look-alikes; path parts; dictionary.
SECRET_WORDS = frozenset("password passwd passphrase pwd pass secret token apikey api_key access_key accesskey secret_key auth authorization bearer credential credentials private_key client_secret key login".split())
PLAIN_WORDS = frozenset("sha sha1 sha256 sha512 md5 hash checksum digest commit revision rev uuid guid id etag integrity version build serial isbn order invoice tracking session_id request_id trace span example dummy placeholder sample test fake mock changeme color colour url http https image data base64".split())
PATH_WORDS = frozenset("test tests spec example examples sample samples doc docs fixture fixtures mock mocks vendor lock dist min readme tutorial".split())
#: Words that made findings are put together from.
COMMON = (
    "password secret token sample testing user admin root login account default change value string insert data base file path name host server client local config "
    "setting service production staging main branch release version build docker image library package module class function method object array index number order "
    "item product customer invoice report document page content article title header style color width height left right center photo video music message email phone "
    "address street city country time date year month week hour first last next start stop open close read write create update delete select group limit hello world other"
).split()
#: Lengths of words that count as dictionary words.
LEAST_WORD, MOST_WORD = 4, 14
#: Score from which a finding counts as a secret.
SECRET_FROM = 0.5
FEATURES = (
    "length", "transitions", "classes", "digits", "upper", "lower", "signs", "hex", "entropy", "bigrams", "dictionary", "repeats",
    "shaped", "path", "secret_before", "plain_before", "secret_after", "plain_after", "assigned", "quoted", "parts",
)
NEAR = 60


@dataclass
class Finding:
    kind: str
    start: int
    value: str
    before: str
    after: str


def _names_secret(name: str) -> bool:
    """Whether a word for secrets is a name's part between signs or humps, ends such a part or, from five letters on, is inside one."""
    low = name.lower()
    parts = {*re.split(r"[\W_]+", low), *(p.lower() for p in _HUMPS.findall(name)), low}
    return bool(SECRET_WORDS & parts) or any(p.endswith(w) or (len(w) > 4 and w in p) for p in parts for w in SECRET_WORDS)


def _values(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, text before) of values that go with a name; what no sign assigns is described as if one did."""
    found = []
    for m in _ASSIGN.finditer(text):
        name = _NAME.search(text[max(0, m.start() - 46) : m.start()])
        if name and _names_secret(name[1]):
            value = _VALUE.match(text, m.end())
            if value:
                start, stop = value.span(value.lastgroup)
                found.append((start, stop, text[max(0, start - NEAR) : start]))
    if "://" in text:
        found += [(m.start(1), m.end(1), f"{text[max(0, m.start() - NEAR) : m.start()].rpartition(' ')[0]} password:") for m in _USER_INFO.finditer(text)]
    found += [(m.start(1), m.end(1), f"{text[max(0, m.start() - NEAR) : m.start()]}bearer: ") for m in _BEARER.finditer(text)]
    if "</" in text:
        found += [(m.start(2), m.end(2), f"{text[max(0, m.start() - NEAR) : m.start()]} {m[1]}:") for m in _ELEMENT.finditer(text) if _names_secret(m[1])]
    return found


def candidates(text: str) -> list[Finding]:
    """All candidate values of a text, in order; overlapping ones are joined to their whole extent, of the kind that is shaped or else assigned.

    Shapes are searched first, and long runs only in what is left. An assigned
    URL is joined with nothing inside it, so it may overlap others.
    """
    found = [(m.start(), 0, m.end(), m.lastgroup, None) for m in _SHAPED.finditer(text)]
    left = text
    if found:
        ends = [0, *(x for f in found for x in (f[0], f[2])), len(text)]
        left = "".join("\n" * (b - a) if k % 2 else text[a:b] for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)))
    found += [(m.start(), 2, m.end(), "long_run", None) for m in _RUN.finditer(left)]
    urls: list[tuple] = []
    for start, stop, before in _values(text):
        (urls if "://" in text[start:stop] else found).append((start, 1, stop, "assigned", before))
    joined: list[list] = []
    for start, rank, stop, kind, before in sorted(found, key=lambda f: f[:3]):
        if joined and start < joined[-1][2]:
            last = joined[-1]
            if start == last[0] and last[4] is None:
                last[4] = before
            last[1], last[3] = min((last[1], last[3]), (rank, kind))
            last[2] = max(last[2], stop)
        else:
            joined.append([start, rank, stop, kind, before])
    urls = [u for u in urls if not any(j[0] <= u[0] and u[2] <= j[2] for j in joined)]
    near = lambda start, stop, before: (text[max(0, start - NEAR) : start] if before is None else before[-NEAR:], text[stop : stop + NEAR])
    return [Finding(kind, start, text[start:stop], *near(start, stop, before)) for start, _, stop, kind, before in sorted([*joined, *urls], key=lambda f: tuple(f[:3]))]


def _settled(text: str, found: list[tuple[Finding, float]]) -> list[tuple[Finding, float]]:
    """Findings without overlaps: secrets are joined to their whole extent, and others that meet one already kept go."""
    out: list[tuple[Finding, float]] = []
    for f, s in sorted((x for x in found if x[1] >= SECRET_FROM), key=lambda x: x[0].start):
        if out and f.start < (end := out[-1][0].start + len(out[-1][0].value)):
            last, most = out[-1]
            stop = max(end, f.start + len(f.value))
            kind = f.kind if last.kind in ("long_run", "assigned") else last.kind
            out[-1] = (Finding(kind, last.start, text[last.start : stop], last.before, text[stop : stop + NEAR]), max(s, most))
        else:
            out.append((f, s))
    for f, s in sorted((x for x in found if x[1] < SECRET_FROM), key=lambda x: (x[0].kind in ("long_run", "assigned"), x[0].start)):
        if all(f.start >= o.start + len(o.value) or o.start >= f.start + len(f.value) for o, _ in out):
            out.append((f, s))
    return sorted(out, key=lambda x: x[0].start)


def _classes(value: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value)


def dictionary(path: str) -> frozenset[str]:
    """Whole words of the vocabulary file at ``path``."""

    def load() -> frozenset[str]:
        with open(path, encoding="utf-8") as f:
            words = (w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"] if w.endswith("</w>"))
            return frozenset(w for w in words if LEAST_WORD <= len(w) <= MOST_WORD and w.isascii() and w.isalpha())

    return worker_cache(f"words {path}", load)


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, from the left, the longest first."""
    low, covered = value.lower(), 0
    for run in re.findall("[a-z]+", low):
        at = 0
        while at + LEAST_WORD <= len(run):
            size = next((k for k in range(min(MOST_WORD, len(run) - at), LEAST_WORD - 1, -1) if run[at : at + k] in words), 0)
            covered += size
            at += size or 1
    letters = sum(map(str.isalpha, low))
    return covered / letters if letters else 0.0


_PAIRS = frozenset(w[i : i + 2] for w in COMMON for i in range(len(w) - 1))


def describe(f: Finding, path: str | None, words: frozenset[str]) -> list[float]:
    """The values of ``FEATURES``."""
    v = f.value
    kinds, n = _classes(v), len(v)
    counts = [v.count(c) for c in set(v)]
    letters = re.findall("[a-z]{2,}", v.lower())
    pairs = [w[i : i + 2] for w in letters for i in range(len(w) - 1)]
    before, after = re.findall(r"[\w-]+", f.before.lower())[-3:], re.findall(r"[\w-]+", f.after.lower())[:2]
    pieces = {p for w in before for p in [w, *re.split(r"[-_]", w)]}
    return [
        min(n, 256), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), len(set(kinds)), kinds.count("d") / n, kinds.count("u") / n,
        kinds.count("l") / n, kinds.count("s") / n, sum(c in string.hexdigits for c in v) / n, -sum(c / n * math.log2(c / n) for c in counts),
        sum(p in _PAIRS for p in pairs) / len(pairs) if pairs else 0.0, _coverage(v, words), max(counts) / n, float(f.kind not in ("long_run", "assigned")),
        float(bool(PATH_WORDS & set(re.findall("[a-z]+", (path or "").lower())))), float(bool(SECRET_WORDS & pieces)), float(bool(PLAIN_WORDS & pieces)),
        float(bool(SECRET_WORDS & set(after))), float(bool(PLAIN_WORDS & set(after))), float(bool(re.search(r"[=:]>?\s*[\"']?$", f.before))), float(f.before[-1:] in ("\"", "'") and f.before[-1:] == f.after[:1]),
        len(re.split(r"[-_/.+]", v)),
    ]


class Forest:
    """Trees of Gini splits on bootstrap samples, each node over a random choice of features. words: path of its vocabulary file."""

    def __init__(self, words: str, trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 11):
        self.words = words
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        size = (2 << self.depth) - 1
        self.feature = np.full((self.trees, size), -1, np.int16)
        self.cut = np.zeros((self.trees, size), np.float32)
        self.share = np.zeros((self.trees, size), np.float32)
        pick = max(1, int(math.sqrt(x.shape[1])) + 1)
        for t in range(self.trees):
            todo = [(0, rng.integers(0, len(x), len(x)))]
            while todo:
                node, rows = todo.pop()
                own = y[rows]
                self.share[t, node] = own.mean()
                if 2 * node + 2 >= size or len(rows) < 2 * self.leaf or own.min() == own.max():
                    continue
                best = (len(rows) * 2 * own.mean() * (1 - own.mean()) - 1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], pick, replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, ones = x[rows[order], f], np.cumsum(own[order])
                    k = np.arange(1, len(v))
                    left, right = ones[:-1], ones[-1] - ones[:-1]
                    impure = 2 * left * (k - left) / k + 2 * right * (len(v) - k - right) / (len(v) - k)
                    impure[(v[1:] == v[:-1]) | (k < self.leaf) | (len(v) - k < self.leaf)] = np.inf
                    i = int(np.argmin(impure))
                    if impure[i] < best[0]:
                        best = (impure[i], f, (v[i] + v[i + 1]) / 2)
                if best[1] >= 0:
                    self.feature[t, node], self.cut[t, node] = best[1], best[2]
                    low = x[rows, best[1]] <= self.cut[t, node]
                    todo += [(2 * node + 1, rows[low]), (2 * node + 2, rows[~low])] if low.any() and (~low).any() else []
                    if not (low.any() and (~low).any()):
                        self.feature[t, node] = -1
        return self

    def arrays(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """What :meth:`of` makes the forest from again; broadcasts hold these, as workers may not know this class."""
        return self.words, self.feature, self.cut, self.share

    @classmethod
    def of(cls, words: str, feature: np.ndarray, cut: np.ndarray, share: np.ndarray) -> Forest:
        forest = cls(words, trees=len(feature), depth=(feature.shape[1] + 1).bit_length() - 2)
        forest.feature, forest.cut, forest.share = feature, cut, share
        return forest

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                f = self.feature[t, node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > self.cut[t, node]), node)
            total += self.share[t, node]
        return total / self.trees


def made_findings(n: int = 6000, seed: int = 5) -> list[tuple[Finding, str, int]]:
    """Labelled findings (finding, path, label) made from public formats of credentials and of look-alikes, for want of a table of them.

    Every shape has real values and placeholders. Real ones are mostly in
    sources and settings; look-alikes are oftener in tests and documentation and
    have words about examples, hashes and ids beside them.
    """
    rng = np.random.default_rng(seed)
    up, low, digit = string.ascii_uppercase, string.ascii_lowercase, string.digits
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    one = lambda xs: xs[rng.integers(0, len(xs))]
    word = lambda: one(COMMON)
    filler = lambda k: " ".join(chars(low, int(rng.integers(2, 9))) for _ in range(k)) if rng.random() < 0.5 else " ".join(word() for _ in range(k))
    hexes, b64, alnum = digit + "abcdef", up + low + digit + "+/", up + low + digit
    shaped = {
        "aws_key_id": (lambda: one(["AKIA", "ASIA"]), lambda: chars(up + digit, 16)),
        "github_token": (lambda: one(["ghp_", "gho_", "ghs_"]), lambda: chars(alnum, 36)),
        "slack_token": (lambda: one(["xoxb-", "xoxp-"]), lambda: f"{chars(digit, 11)}-{chars(digit, 12)}-{chars(alnum, 24)}"),
        "json_web_token": (lambda: "eyJ", lambda: f"{chars(b64[:-2], 20)}.{chars(b64[:-2], 40)}.{chars(b64[:-2], 43)}"),
        "live_key": (lambda: one(["sk_live_", "rk_live_"]), lambda: chars(alnum, int(rng.integers(24, 60)))),
        "google_key": (lambda: "AIza", lambda: chars(alnum + "_-", 35)),
        "private_key": (lambda: f"-----BEGIN {one(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n", lambda: "\n".join(chars(b64, 64) for _ in range(int(rng.integers(3, 20)))) + "\n-----END PRIVATE KEY-----"),
    }
    sources = ["src", "app/config", "deploy", "web", "conf.d", "data", "lib/client", "settings", ".env", "src7"]
    asides = ["test/unit", "docs", "examples", "spec/fixtures", "README", "tutorial", "samples"]
    plain = ["example", "sample", "dummy", "fake", "placeholder", "test", "mock"]
    kinds = sorted(shaped)
    out: list[tuple[Finding, str, int]] = []
    while len(out) < n:
        name = one(["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth_token", "client_secret", "key"])
        sep, quote = one(["=", " = ", ": ", ":"]), one(["", "", "\"", "'"])
        assigned, closed = f"{filler(5)} {name}{sep}{quote}", f"{quote} {filler(5)}"
        before, after, shape = f"{filler(6)} ", f" {filler(6)}", "long_run"
        label, kind = int(rng.random() < 0.5), int(rng.integers(0, 8))
        path = one(asides if rng.random() < (0.05 if label else 0.5) else sources)
        if label:
            if kind < 4:
                shape = one(kinds)
                value = shaped[shape][0]() + shaped[shape][1]()
                if kind < 2:
                    before, after = assigned, closed
            elif kind == 4:
                made = [chars(alnum + "!@#$%^&*", int(rng.integers(8, 24))), word() + chars(alnum, int(rng.integers(5, 10))), word().title() + chars(digit, 3) + one("!@#$%&*") + chars(alnum, 3)]
                value, shape, before, after = one(made), "assigned", assigned, closed
            elif kind == 5:
                value, before, after = chars(b64, int(rng.integers(24, 90))), assigned, closed
            else:
                value, shape, before, after = chars(hexes, int(one([16, 18, 20, 32, 40, 64]))), "assigned", assigned, closed
            if rng.random() < 0.1:
                after = f"{quote} {one(['secret', 'token', 'key', 'password', 'credentials'])}{after}"
        else:
            if kind in (0, 1):  # placeholders of a shape
                shape = one(kinds)
                fill = one(["x" * 40, "EXAMPLE" * 6, "".join(f"{w.title()}" for w in [*plain, "your", "key", "here"]), chars(up, 6) + "EXAMPLE" * 5, "0" * 40, "123456789" * 5, "abcdefghij" * 4, "YOUR" + word().upper() * 8])
                size = len(shaped[shape][1]())
                value = shaped[shape][0]() + (fill * 30)[:size] if shape != "private_key" else shaped[shape][0]() + one(["...", "your key here", "MIIexample", fill]) + "\n-----END PRIVATE KEY-----"
                if rng.random() < 0.5:
                    before, after = assigned, closed
            elif kind == 2:  # real-looking, but said to be none, outside of sources
                shape = one([*kinds, "assigned"])
                value = shaped[shape][0]() + shaped[shape][1]() if shape in shaped else chars(alnum, 24)
                path, beside = one(asides), one(plain)
                before, after = (f"{filler(4)} {beside} {name}{sep}{quote}", closed) if rng.random() < 0.5 else (assigned, f"{quote} {beside} {filler(4)}")
            elif kind == 3:
                value, before = chars(hexes, int(one([32, 40, 64]))), f"{filler(5)} {one(['commit', 'sha256', 'md5', 'checksum', 'revision', 'digest', 'hash', 'etag'])}{one([' ', ': ', '=', ':'])}"
            elif kind == 4:
                value, shape, before, after = one(["changeme", "password", "yourpassword", "example", "placeholder", "your_token_here", "xxxxxxxx", "********", "string", "${PASSWORD}", "None,", "required", "test1234", "secret123", word() + word(), word() + "_" + word()]), "assigned", assigned, closed
            elif kind == 5:
                value = one([one(["-", "_"]).join(word() for _ in range(int(rng.integers(3, 6)))) + f"-{rng.integers(1, 999)}", "/".join([word(), word(), chars(digit, 4), word() + "-" + word()])])
                before = f"{filler(4)} {one(['url', 'http', 'see', 'path', filler(1)])} "
            elif kind == 6:
                value, before = one([chars(digit, int(rng.integers(20, 30))), "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))]), f"{filler(4)} {one(['order', 'tracking', 'serial', 'invoice', 'uuid', 'id', 'request_id', filler(1)])}{one([' ', ': ', '='])}"
            else:
                value, before = chars(b64, int(rng.integers(40, 120))), f"{filler(4)} {one(['data', 'image', 'base64', 'integrity'])}{one([':', '=', ','])}"
            if rng.random() < 0.1:
                after = f"{quote} {one([*plain, 'checksum', 'hash', 'uuid'])}{after}"
        out.append((Finding(shape, 0, value, before[-NEAR:], after[:NEAR]), path, label))
    return out


def train_forest(labelled: Sequence[tuple[Finding, str | None, int]] | None = None, words: str | None = None) -> Forest:
    """A forest from labelled findings; without any, from made ones. words: path of the vocabulary file whose words are the dictionary."""
    rows = list(labelled) if labelled is not None else made_findings()
    words = words or vocabulary("word_bpe_49k.json")
    known = dictionary(words)
    return Forest(words).fit(np.array([describe(f, path, known) for f, path, _ in rows], np.float32), np.array([y for *_, y in rows], np.float64))


FOUND = "doc_id long, start long, length long, kind string, value_sha256 string, score double, is_secret boolean"


def _scored(texts: list[str | None], paths: list[str | None], forest: Forest) -> Iterator[tuple[int, Finding, float]]:
    """(row, finding, score) of all candidates, overlaps settled."""
    known = dictionary(forest.words)
    found = [(k, f, describe(f, paths[k], known)) for k, t in enumerate(texts) if t for f in candidates(t)]
    if found:
        scores = forest.predict(np.array([d for *_, d in found], np.float32))
        rows: dict[int, list[tuple[Finding, float]]] = {}
        for (k, f, _), s in zip(found, scores, strict=True):
            rows.setdefault(k, []).append((f, float(s)))
        for k, own in rows.items():
            yield from ((k, f, s) for f, s in _settled(texts[k], own))


def _scan(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = [(ids[k], f.start, len(f.value), f.kind, hashlib.sha256(f.value.encode("utf-8", "surrogatepass")).hexdigest(), s, s >= SECRET_FROM) for k, f, s in _scored(batch.column(1).to_pylist(), batch.column(2).to_pylist(), forest)]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def find_secrets(docs: DataFrame, forest: Forest, path_col: str = "source") -> DataFrame:
    """A row a candidate: doc_id, start and length in code points, kind, value_sha256, score, is_secret.

    Null and empty texts have none; null paths count as no path; repeated rows
    are scanned each; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(forest.arrays())
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", path.alias("path")).mapInArrow(lambda it: _scan(it, Forest.of(*held.value)), FOUND)


def _redact(batches: Iterator[pa.RecordBatch], forest: Forest, at: int, path: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(at).to_pylist()
        paths = batch.column(path).to_pylist() if path >= 0 else [None] * len(texts)
        cuts: dict[int, list[Finding]] = {}
        for k, f, s in _scored(texts, paths, forest):
            if s >= SECRET_FROM:
                cuts.setdefault(k, []).append(f)
        for k, own in cuts.items():
            for f in reversed(own):
                texts[k] = f"{texts[k][: f.start]}[{f.kind}]{texts[k][f.start + len(f.value) :]}"
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact_secrets(docs: DataFrame, forest: Forest, path_col: str = "source") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; all rows and columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(forest.arrays())
    at, path = docs.columns.index("text"), docs.columns.index(path_col) if path_col in docs.columns else -1
    return docs.mapInArrow(lambda it: _redact(it, Forest.of(*held.value), at, path), docs.schema)
