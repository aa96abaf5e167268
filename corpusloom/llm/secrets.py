"""Secret scans: fixed patterns, and a character convolutional network for what no pattern names.

Three patterns give base findings, which always stay. Every run of key characters that is long enough is a candidate,
unless it lies within a base finding; a run that reaches beyond one is a candidate as a whole. A small convolutional
network reads each candidate whole, with the characters around it, and gives a probability. It is trained in numpy on
labelled findings that a seeded generator writes: keys, tokens and passwords of many shapes against identifiers, numbers,
hashes, addresses, paths and words, some of which only their context tells apart. Findings of a second fold calibrate it
by isotonic regression; on a third the threshold is the highest that still finds ``RECALL`` of the secrets.

Edge cases: null and empty texts have no findings (the digest of the empty string); candidates of any length are read
whole, in blocks, so memory does not grow with their length; offsets count code points; findings that start together are
listed by kind; repeated rows are scanned alike; further columns are left alone, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import isotonic

#: The patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{12,}")
DIGIT = re.compile(r"[0-9]")
LEAST, LEAST_PLAIN = 12, 16  # characters of a candidate with a digit, and without

BEFORE, AFTER = 24, 12  # characters of context
SYMBOLS = 130  # 0 pads, 1 is any character outside ASCII
WIDTH, FILTERS, EMBED = 5, 24, 8
RECALL = 0.98
FINDINGS = 12_000  # labelled findings that are generated
BLOCK = 50_000  # characters that go through the network at once


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base findings."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no base finding covers."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        got = m[0].rstrip(".=-")
        start, end = m.start(), m.start() + len(got)
        while k < len(base) and base[k][2] <= start:
            k += 1
        if len(got) < LEAST or len(got) < LEAST_PLAIN and not DIGIT.search(got):
            continue
        covered, at = False, k
        while at < len(base) and base[at][0] <= start:
            covered |= base[at][2] >= end
            at += 1
        if not covered:
            out.append((start, end))
    return out


# --- the network ---------------------------------------------------------------------------------------------------


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a candidate and its context; those of the candidate are of a second alphabet."""
    lo, hi = max(0, start - BEFORE), min(len(text), end + AFTER)
    code = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    got = np.where(code < 128, code + 2, 1).astype(np.int32)
    got[start - lo : end - lo] += SYMBOLS
    return got


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over the text, one linear layer; then calibration and threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray
    threshold: float = 0.5

    def forward(self, ids: np.ndarray):
        x = self.embed[ids] * (ids > 0)[:, :, None]
        n = ids.shape[1] - WIDTH + 1
        cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(ids), n, -1)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        there = (ids[:, WIDTH // 2 : WIDTH // 2 + n] > 0)[:, :, None]
        z = z * there
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.sum(axis=1) / np.maximum(1, there.sum(axis=1))], axis=1)
        return pooled @ self.out + self.out_bias[0], (cols, z, there, top, pooled)

    def logits(self, windows: list[np.ndarray]) -> np.ndarray:
        """Of windows of any length; those of like length go together, long ones in blocks."""
        order, out, k = sorted(range(len(windows)), key=lambda i: len(windows[i])), np.zeros(len(windows)), 0
        while k < len(order) and len(windows[order[k]]) <= BLOCK:
            to = k + 1
            while to < len(order) and (to + 1 - k) * len(windows[order[to]]) <= BLOCK:
                to += 1
            out[order[k:to]] = self.forward(padded([windows[i] for i in order[k:to]]))[0]
            k = to
        for i in order[k:]:
            out[i] = self._long_logit(padded([windows[i]]))
        return out

    def _long_logit(self, ids: np.ndarray) -> float:
        """Of one padded window: the maximum and the sum over its places are taken block by block."""
        n, top, total = ids.shape[1] - WIDTH + 1, np.zeros(FILTERS), np.zeros(FILTERS)
        for at in range(0, n, BLOCK):
            z = self.forward(ids[:, at : min(n, at + BLOCK) + WIDTH - 1])[1][1][0]
            top, total = np.maximum(top, z.max(axis=0)), total + z.sum(axis=0)
        return float(np.concatenate([top, total / n]) @ self.out + self.out_bias[0])

    def probability(self, windows: list[np.ndarray]) -> np.ndarray:
        return np.interp(self.logits(windows), self.steps_x, self.steps_y) if windows else np.zeros(0)


def padded(windows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(windows), max(map(len, windows)) + WIDTH - 1), np.int32)
    for row, w in zip(out, windows, strict=True):
        row[WIDTH // 2 : WIDTH // 2 + len(w)] = w
    return out


def shapes(r: np.random.Generator) -> dict[str, tuple[int, object]]:
    """name: (1 for a secret, a function that writes one)."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    many = lambda lo, hi: int(r.integers(lo, hi))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = lower + upper + digits
    word = lambda: _word(r)
    b64 = lambda k: base64.b64encode(r.bytes(k)).decode().rstrip("=")
    secrets = {
        "hex": lambda: r.bytes(many(8, 16)).hex(),
        "base64": lambda: b64(many(12, 48)),
        "alphanumeric": lambda: chars(every, many(14, 64)),
        "letters": lambda: chars(lower + upper, many(18, 40)),
        "ghp": lambda: "ghp_" + chars(every, 36),
        "sk": lambda: "sk-" + chars(every, many(24, 52)),
        "aiza": lambda: "AIza" + chars(every + "_-", 35),
        "jwt": lambda: "eyJ" + b64(20) + "." + b64(60) + "." + b64(32),
        "upper": lambda: chars(upper + digits, many(16, 40)),
        "dashed": lambda: chars(upper + digits, 5) + "-" + chars(every, 24),
        "password": lambda: word().title() + chars(digits, many(2, 5)) + pick("_-+=.") + chars(every, many(5, 9)),
        "url-safe": lambda: chars(every + "_-", many(20, 44)),
        "xoxb": lambda: "xoxb-" + chars(digits, 12) + "-" + chars(every, 24),
        "npm": lambda: "npm_" + chars(every, 36),
        "mailer": lambda: "SG." + chars(every + "_-", 22) + "." + chars(every + "_-", 43),
        "base32": lambda: chars(lower + "234567", many(20, 52)),
        "grouped": lambda: "-".join(chars(every, 8) for _ in range(many(2, 5))),
    }
    harmless = {
        "slug": lambda: "-".join(word() for _ in range(4)) + "-" + chars(digits, 2),
        "snake": lambda: "_".join(word() for _ in range(4)) + chars(digits, many(0, 3)),
        "path": lambda: "/".join(word() for _ in range(4)) + "/" + chars(digits, 4) + ".html",
        "date": lambda: f"{many(1990, 2030)}-{many(10, 13)}-{many(10, 29)}T{many(10, 24)}.{many(10, 60)}.00Z",
        "uuid": lambda: str(uuid.UUID(bytes=r.bytes(16))),
        "host": lambda: ".".join(word() for _ in range(3)) + chars(digits, many(0, 3)) + pick((".example.com", ".org", ".net")),
        "camel": lambda: "".join(word().title() for _ in range(4)) + chars(digits, many(0, 3)),
        "card": lambda: "-".join(chars(digits, 4) for _ in range(3)) + "-" + chars(digits, 3) + pick("abc"),
        "number": lambda: chars(digits, many(12, 24)),
        "float": lambda: chars(digits, 12) + "." + chars(digits, 6) + "e" + chars(digits, 2),
        "version": lambda: "v" + ".".join(chars(digits, many(1, 4)) for _ in range(5)) + "-" + word() + word(),
        "repeat": lambda: pick(lower) * many(10, 30) + pick(digits) * many(6, 12),
        "glued": lambda: "".join(word() for _ in range(6)) + chars(digits, many(0, 5)),
        "long word": lambda: "".join(word() for _ in range(many(4, 8)))[: many(16, 30)].ljust(16, "e"),
        "shout": lambda: "".join(word() for _ in range(many(4, 8)))[: many(16, 30)].upper().ljust(16, "E"),
        "mail host": lambda: word() + chars(digits, many(1, 3)) + "." + pick((word(), "example", "mail")) + pick((".com", ".org", ".net")),
        "account": lambda: pick(("DE", "FR", "ES", "NL")) + chars(digits, many(16, 23)),
        "counted": lambda: "".join(word() + pick(digits) for _ in range(6)),
        "address": lambda: ".".join(str(many(1, 256)) for _ in range(4)) + pick(("", ".in-addr.arpa")),
        "ruler": lambda: pick(("-", "=", "_", ".-", "+-", "/")) * many(14, 40) + pick(digits),
        "short hash": lambda: r.bytes(many(8, 14)).hex(),
        "mac": lambda: "-".join(r.bytes(1).hex().upper() for _ in range(many(6, 9))),
        "file": lambda: word() + "_" + word() + "_v" + chars(digits, 1) + "." + chars(digits, 2) + ".tar.gz",
        "setting": lambda: f"{word()}={many(100, 5000)}.{word()}={many(100, 5000)}.{word()}={many(1, 99)}",
        "book": lambda: f"978-{many(0, 10)}-{many(1000, 9999)}-{many(1000, 9999)}-{many(0, 10)}",
        "sum": lambda: "+".join(str(many(10, 9999)) for _ in range(5)) + "=" + str(many(1000, 99999)),
        "pages": lambda: "/".join(f"{many(10, 500)}-{many(10, 500)}" for _ in range(4)),
        "lot": lambda: word().title() + "." + word() + "-" + chars(digits, 3) + pick(("a", "b", "")) + "-" + word(),
    }
    return {k: (1, f) for k, f in secrets.items()} | {k: (0, f) for k, f in harmless.items()}


#: Shapes that no network trains on; tests measure recall and false alarms on them.
UNSEEN = ("xoxb", "npm", "mailer", "base32", "grouped", "mac", "file", "setting", "book", "pages", "lot")
SYLLABLES = (
    "an re th in er on es tion ed ing ent la que de le os ar un ver sch ge ou ti ha st nd lich keit heit aire ment or sh ea ly wh ble at to con pro "
    "com per al ic ous ness ful less eau ux ien pf tz ung chen berg ck ff ll ss ph qu am em im om um ab ex is it us ap op ad so mi ro ca po ra do"
).split()


def _word(r: np.random.Generator) -> str:
    return "".join(SYLLABLES[int(r.integers(len(SYLLABLES)))] for _ in range(int(r.integers(1, 5))))


def labelled_findings(n: int, seed: int = 7, unseen: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows and labels. Half are secrets; of the shapes that are trained on, or only of those that are not."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    prose = lambda k: " ".join(_word(r) for _ in range(k))
    made = {k: v for k, v in shapes(r).items() if (k in UNSEEN) == unseen}
    names = [[k for k, (y, _) in made.items() if y == want] for want in (0, 1)]
    around = (
        (" token = ", ""), (" key: ", ","), (' "', '"'), (" '", "'"), (" ", " "), (" Bearer ", "\n"), (":", "&"), (" ", "."), ("\n", "\n"), (" (", ")"),
    )
    hashed = (("commit ", " "), ("md5:", "\n"), ("checksum ", "."), ("etag: ", ","), (" revision ", ")"))
    windows, labels = [], []
    for i in range(n):
        name = pick(names[i % 2])
        value = made[name][1]()
        pre, post = pick(hashed if name == "short hash" and r.random() < 0.9 else around)
        left = prose(int(r.integers(0, 6))) + pre
        text = left + value + post + prose(int(r.integers(0, 4)))
        windows.append(window(text, len(left), len(left) + len(value)))
        labels.append(i % 2)
    return windows, np.array(labels)


@lru_cache(maxsize=4)
def train_network(findings: int = FINDINGS, recall: float = RECALL, epochs: int = 8, seed: int = 7) -> Network:
    """Adam on three fifths of the findings, calibration on a fifth, threshold on the last fifth."""
    windows, y = labelled_findings(findings, seed)
    r = np.random.default_rng(seed + 1)
    net = Network(
        r.normal(0, 0.3, (2 * SYMBOLS, EMBED)), r.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS),
        r.normal(0, 0.2, 2 * FILTERS), np.zeros(1), np.zeros(1), np.zeros(1),
    )
    params = [net.embed, net.conv, net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    cut, last = findings * 3 // 5, findings * 4 // 5
    for _ in range(epochs):
        order = r.permutation(cut)
        for k in range(0, cut, 128):
            rows = order[k : k + 128]
            ids = padded([windows[i] for i in rows])
            logit, (cols, z, there, top, pooled) = net.forward(ids)
            d = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            d_pool = d[:, None] * net.out
            d_z = np.broadcast_to((d_pool[:, FILTERS:] / np.maximum(1, there.sum(axis=1)))[:, None], z.shape).copy()
            at = top[:, None]
            np.put_along_axis(d_z, at, np.take_along_axis(d_z, at, 1) + d_pool[:, None, :FILTERS], 1)
            d_z *= (z > 0) & there
            d_cols = (d_z @ net.conv.T).reshape(*z.shape[:2], WIDTH, EMBED)
            d_x = np.zeros((*ids.shape, EMBED))
            for w in range(WIDTH):
                d_x[:, w : w + z.shape[1]] += d_cols[:, :, w]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, ids.ravel(), (d_x * (ids > 0)[:, :, None]).reshape(-1, EMBED))
            grads = [d_embed, cols.reshape(-1, WIDTH * EMBED).T @ d_z.reshape(-1, FILTERS), d_z.sum(axis=(0, 1)), pooled.T @ d, d.sum(keepdims=True)]
            t += 1
            for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= 0.01 * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
    net.steps_x, net.steps_y = isotonic(net.logits(windows[cut:last]), y[cut:last].astype(float))
    found = np.sort(net.probability(windows[last:])[y[last:] == 1])
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


# --- scanning ------------------------------------------------------------------------------------------------------


def scan(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, index of kind, end) of all findings of each text, in order."""
    found = [base_findings(t) for t in texts]
    where, windows = [], []
    for i, text in enumerate(texts):
        for start, end in candidates(text, found[i]):
            where.append((i, start, end))
            windows.append(window(text, start, end))
    for (i, start, end), p in zip(where, net.probability(windows), strict=True):
        if p >= net.threshold:
            found[i].append((start, 3, end))
    return [sorted(f) for f in found]


def render(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def findings_column(net: Network):
    """text -> array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def findings(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in scan([t or "" for t in text], net)])

    return findings


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every finding replaced; findings that overlap are replaced together."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_column(net: Network):
    """text -> text without its secrets; null stays null."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, f) for t, f in zip(text, scan([t or "" for t in text], net), strict=True)])

    return clean


def redact_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` without their secrets; ``n_chars`` follows the text where there is such a column."""
    clean = docs.withColumn("text", redact_column(net or train_network())("text"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def digest_column(net: Network):
    @F.pandas_udf("struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string,n_model:long>")
    def digest(text: pd.Series) -> pd.DataFrame:
        out = []
        for found in scan([t or "" for t in text], net):
            n = [sum(k == i for _, k, _ in found) for i in range(4)]
            base = render([f for f in found if f[1] < 3])
            out.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), render(found), n[3]))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return digest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: secrets of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", digest_column(train_network())("text").alias("d")).select("doc_id", "d.*")
