"""Secret scan: fixed patterns, and a linear-chain conditional random field that finds more.

Tokens are tagged outside (0), secret begin (1) or inside (2). Features are the token's shape, the two words on either
side (hashed), the characters beside it, and the file it stands in. The field is trained in numpy on windows of a bounded
sample and decoded by Viterbi over all tokens of every text. Its tags come from the fixed patterns, and from secrets made
for fitting: random keys, passwords and codes that stand in the sample's own texts behind words the patterns don't know
(:func:`made_window`), next to numbers, paths, dates and names that are none.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import buffers as B
from heronry.llm.store import small_batches
from heronry.shared import spread

# Fixed patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = "0123456789abcdef"  # runs of these
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")

#: Words that, standing before a token, say what it is.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "login", "private", "access")
#: Tokens on either side of a training window's middle, windows of one document at most, and of those made for fitting.
REACH, PER_DOC, MADE = 8, 24, 8
#: Neighbouring words that features tell, and buckets of their hashes.
NEAR, HASHED = (-2, -1, 1, 2), 1024


def _class(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in "".join(chars)]] = True
    return out


_DIGIT, _UPPER, _LOWER = _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_WIDE = np.arange(256) >= 128
_MARK = _class("_+/.-")
_HEX = _class(HEX)
_TOKEN = _DIGIT | _UPPER | _LOWER | _WIDE | _MARK
_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 48])
_CUES = np.sort(B.span_hashes(np.frombuffer("".join(CUES).encode(), np.uint8), *(np.cumsum([0, *map(len, CUES)])[k : len(CUES) + k] for k in (0, 1))))

SHAPES = ("digit", "upper", "lower", "wide", "mark", "digit+lower", "digit+upper", "digit+upper+lower", "digits only", "upper and digits only", "many changes", "few changes a char")
BESIDE = ("after =", "after : or = and quote", "before quote", "line start", "cue word before", "cue word two before", "mixed word before", "mixed word after", "at sign beside")
FILE = ("short file", "long file", "= or quote in file", "cue in file")
N_FEATURES = 1 + len(_LENGTHS) + 1 + len(SHAPES) + len(BESIDE) + len(FILE)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of token characters. Texts of a buffer are apart by a line feed."""
    ink = np.concatenate(([False], _TOKEN[data], [False]))
    change = np.flatnonzero(ink[1:] != ink[:-1])
    return change[::2], change[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the tokens with A-Z lowered."""
    return B.span_hashes(B.lower_ascii(data), starts, ends)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, file_edges: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of N_FEATURES each token has, as booleans. ``file_edges``: where each text begins, and the end."""
    n, size = len(starts), ends - starts
    x = np.zeros((N_FEATURES, n), bool)
    x[0] = True
    x[1 + np.searchsorted(_LENGTHS, size, "right"), np.arange(n)] = True

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    kind = _DIGIT[data].astype(np.int8) + 2 * (_LOWER | _WIDE)[data] + 3 * _UPPER[data]
    change = np.zeros(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    digit, upper, lower, wide, mark, changes = (count(m) for m in (_DIGIT[data], _UPPER[data], _LOWER[data], _WIDE[data], _MARK[data], change))
    d, u, low = digit > 0, upper > 0, lower > 0
    at = 2 + len(_LENGTHS)
    shapes = (d, u, low, wide > 0, mark > 0, d & low, d & u, d & u & low, digit == size, (digit + upper == size) & d & u, changes >= 4, (changes * 8 < size) & (size >= 8))
    x[at : at + len(shapes)] = shapes
    at += len(shapes)

    def char(where: np.ndarray) -> np.ndarray:
        return np.where((where >= 0) & (where < len(data)), data[np.clip(where, 0, len(data) - 1)], 10)

    one, two, after = char(starts - 1), char(starts - 2), char(ends)
    quote = (one == 34) | (one == 39)
    start = np.clip(np.searchsorted(file_edges, starts, "right") - 1, 0, len(file_edges) - 2)
    cue = np.isin(hashes, _CUES)
    mixed = d & (size >= 6)

    def shifted(v: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, bool)
        if by > 0:
            out[by:] = v[:-by] & (start[by:] == start[:-by])
        else:
            out[:by] = v[-by:] & (start[:by] == start[-by:])
        return out

    far = char(starts - 3)
    beside = (one == 61, quote & ((two == 61) | (two == 58) | (far == 61) | (far == 58)), (after == 34) | (after == 39), (one == 10), shifted(cue, 1) if n > 1 else np.zeros(n, bool), shifted(cue, 2) if n > 2 else np.zeros(n, bool), shifted(mixed, 1) if n > 1 else np.zeros(n, bool), shifted(mixed, -1) if n > 1 else np.zeros(n, bool), (one == 64) | (after == 64))
    x[at : at + len(beside)] = beside
    at += len(beside)
    length = np.diff(file_edges)
    files = len(file_edges) - 1
    odd = np.flatnonzero((data == 61) | (data == 34))
    has_odd = np.bincount(np.clip(np.searchsorted(file_edges, odd, "right") - 1, 0, files - 1), minlength=files) > 0
    has_cue = np.bincount(start[cue], minlength=files) > 0
    x[at : at + len(FILE)] = [(length < 500)[start], (length > 20_000)[start], has_odd[start], has_cue[start]]
    return x


def neighbours(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, file_edges: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bucket of each token's neighbouring words (NEAR x tokens), HASHED where the text has none there."""
    n = len(starts)
    word = (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    # a word that looks like a code is told by its looks: it won't be met again
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    word[digits[ends] > digits[starts]] = 0
    text = np.searchsorted(file_edges, starts, "right")
    out = np.full((len(NEAR), n), HASHED, np.int16)
    for row, by in zip(out, NEAR, strict=True):
        if abs(by) < n:
            here, there = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
            row[here] = np.where(text[here] == text[there], word[there], HASHED)
    return out


def _places(data: bytes, words: tuple[bytes, ...]) -> list[int]:
    """Where any of the words begins, in order."""
    out = []
    for w in words:
        at = data.find(w)
        while at >= 0:
            out.append(at)
            at = data.find(w, at + 1)
    return sorted(out)


def _matches(pattern: re.Pattern, data: bytes, places: list[int]) -> Iterator[re.Match]:
    """The matches that a search from the left finds, which begin at one of ``places``."""
    end = 0
    for at in places:
        if at >= end and (m := pattern.match(data, at)):
            yield m
            end = m.end()


def assigned(data: bytes) -> list[re.Match]:
    """Matches of the pattern of assignments whose value is long enough; each begins with one of its words."""
    return [m for m in _matches(ASSIGN, data, _places(data.lower(), (b"passw", b"secret", b"token", b"api"))) if m.end(2) - m.start(2) >= LEAST_VALUE]


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns in bytes, leftmost and without overlap in each kind, by start and kind."""
    out = [(m.start(), m.end(), 0) for m in assigned(data)]
    out += [(m.start(), m.end(), 1) for m in _matches(ACCESS, data, _places(data, (b"AKIA",))) if m.end() - m.start() >= LEAST_ACCESS]
    ink = np.concatenate(([False], _HEX[np.frombuffer(data, np.uint8)], [False]))
    change = np.flatnonzero(ink[1:] != ink[:-1])
    a, b = change[::2], change[1::2]
    long = b - a >= LEAST_HEX
    return sorted(out + [(i, j, 2) for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True)])


def _tags(starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
    """Tags that the fixed patterns give: the tokens of an assigned value, of a key and of a hex run."""
    tags = np.zeros(len(starts), np.int8)
    spans = [m.span(2) for m in assigned(data)]
    spans += [(a, b) for a, b, kind in base_spans(data) if kind]
    for a, b in sorted(spans):
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
        tags[i:j] = 2
        tags[i : i + 1] = 1
    return tags


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Words that announce a secret in windows made for fitting; the fixed patterns know none of them.
ANNOUNCE = ("pwd", "passphrase", "pass", "credential", "credentials", "bearer", "auth", "authorization", "login", "private key", "access key", "signing key", "encryption key", "license key", "client id", "session", "cookie", "webhook", "pin", "unlock code", "key")
_JOIN = ("=", "=", ": ", ": ", " = ", " is ", " ", " -> ", '="', ": '", ' is "')


def _made_secret(rng: random.Random) -> str:
    alnum = _LETTERS + _LETTERS.upper() + "0123456789" * 2
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    kind = rng.randrange(8)
    if kind == 0:
        return some(alnum, 16, 44)
    if kind == 1:
        return some(alnum + "+/", 20, 60)
    if kind == 2:
        return "-".join(some(_LETTERS.upper() + "0123456789" * 3, 4, 6) for _ in range(rng.randint(3, 5)))
    if kind == 3:
        return some(_LETTERS, 2, 4) + rng.choice("_-") + some(alnum, 16, 40)
    if kind == 4:
        return some(alnum, 4, 8) + some("0123456789", 1, 3) + some(_LETTERS.upper(), 1, 3)
    if kind == 5:
        return some(_LETTERS.upper() + "0123456789", 16, 32)
    if kind == 6:
        return ".".join(some(alnum + "_-", 12, 40) for _ in range(3))
    return some(alnum, 3, 7) + rng.choice("!@#$%^&*") + some(alnum, 3, 7) + some("0123456789", 1, 3)


def _made_other(rng: random.Random) -> str:
    """What looks a little like a secret and is none."""
    digit = lambda a, b: "".join(rng.choice("0123456789") for _ in range(rng.randint(a, b)))
    word = lambda: "".join(rng.choice(_LETTERS) for _ in range(rng.randint(3, 9)))
    return (
        lambda: digit(2, 12),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{word()}/{word()}/{word()}.{rng.choice(('html', 'py', 'txt', 'mp3'))}",
        lambda: f"{word()}.{word()}@{word()}.com",
        lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{word().upper()}-{digit(2, 4)}",
        lambda: f"+{digit(2, 2)} {digit(3, 3)} {digit(6, 8)}",
        lambda: ".".join(digit(1, 3) for _ in range(4)),
        lambda: word() + word().title() + rng.choice(("", "2", "Id")),
        lambda: f"https://{word()}.com/{word()}/{digit(3, 6)}",
        lambda: word(),
        lambda: word().title() + " " + word(),
    )[rng.randrange(12)]()


def made_window(text: str, rng: random.Random, announce: tuple[str, ...] = ANNOUNCE) -> tuple[str, list[tuple[int, int]]]:
    """A stretch of the text with a secret in it, or something that is none, and the secret's span (none: empty)."""
    at = rng.randrange(max(1, len(text) - 400))
    words = text[at : at + 400].split(" ")[1:-1] or ["a"]
    cut = rng.randint(0, len(words))
    before, after = " ".join(words[:cut]), " ".join(words[cut:])
    before += rng.choice(("\n", " ", " ")) if before else ""
    hidden = rng.random() < 0.6
    if rng.random() < 0.85 or hidden:
        word = rng.choice(announce)
        word = rng.choice((word, word, word.upper(), word.title(), word.replace(" ", "_")))
        join = rng.choice(_JOIN)
        before += word + join
        quote = join[-1] if join[-1] in "\"'" else ""
        after = quote + rng.choice(("\n", " ", " ")) + after
    else:
        after = " " + after
    value = _made_secret(rng) if hidden else _made_other(rng)
    start = len(before)
    return before + value + after, [(start, start + len(value))] if hidden else []


def _tagged(raw: bytes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, neighbours and tags of a text's tokens, and the tokens; ``spans`` (bytes) are secrets as well."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = tokens(data)
    tags = _tags(starts, ends, raw)
    for a, b in spans:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
        tags[i:j] = 2
        tags[i : i + 1] = 1
    edges = np.array([0, len(data)])
    hashes = word_hashes(data, starts, ends)
    return features(data, starts, ends, edges, hashes), neighbours(data, starts, ends, edges, hashes), tags, np.stack((starts, ends))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows of sampled texts: about tagged tokens, about others with digits, a plain one, and made ones."""
    width = 2 * REACH + 1

    def cut(raw: bytes, spans: list[tuple[int, int]], most: int) -> tuple[list, list, list]:
        x, near, tags, (starts, ends) = _tagged(raw, spans)
        if len(starts) < width:
            return [], [], []
        if spans:
            middle = np.searchsorted(starts, [a for a, _ in spans])
        else:
            digits = np.flatnonzero(x[2 + len(_LENGTHS)] & (tags == 0) & (ends - starts >= 4))
            middle = np.concatenate((np.flatnonzero(tags == 1)[: most // 2], digits[: most // 4], [len(starts) // 2]))
        rows = np.clip(middle, REACH, len(starts) - REACH - 1)[:, None] + np.arange(-REACH, REACH + 1)
        return [x.T[r].tobytes() for r in rows], [near.T[r].tobytes() for r in rows], [tags[r].tobytes() for r in rows]

    for batch in batches:
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            if not raw:
                continue
            got = [cut(raw, [], PER_DOC)]
            rng = random.Random(zlib.crc32(raw))
            for _ in range(MADE):
                made, spans = made_window(text, rng)
                got.append(cut(made.encode(), [(len(made[:a].encode()), len(made[:b].encode())) for a, b in spans], 2))
            x, near, y = ([v for g in got for v in g[k]] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(near, pa.binary()), pa.array(y, pa.binary())], ["x", "near", "y"])


class Field:
    """Weights: features x 3, neighbouring words (NEAR x buckets) x 3, and 3 x 3 from tag to tag."""

    def __init__(self, emit: np.ndarray, words: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.words, self.move = emit, words, move

    def scores(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Tokens x 3, of features x tokens and NEAR x tokens."""
        out = self.emit.T @ x.astype(self.emit.dtype)
        for table, at in zip(self.words, near, strict=True):
            at = at.astype(np.intp)
            for row, column in zip(out, table.T, strict=True):
                row += np.take(column, at)
        return out.T

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of chains of one length: chains x tokens, of chains x tokens x 3."""
        chains, length, _ = scores.shape
        best, back = scores[:, 0], np.zeros(scores.shape, np.int8)
        for t in range(1, length):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, t]
        tags = np.empty((chains, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(chains)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags

    def decode(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Viterbi tags of the chains of all texts.

        Where tag 0 leads by more than any two transitions can differ, the best chain holds tag 0 there; the chain is
        cut at such tokens and only what lies between is searched, from one to the next, all stretches of a length at
        once. Tags are those of the whole.
        """
        n = len(scores)
        sure = scores[:, 0] - np.maximum(scores[:, 1], scores[:, 2]) > 2 * (self.move.max() - self.move.min())
        tags = np.zeros(n, np.int8)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return tags
        cut = np.flatnonzero((np.diff(open_) > 1) | (text[open_[1:]] != text[open_[:-1]])) + 1
        a, b = open_[np.append(0, cut)], open_[np.append(cut, len(open_)) - 1] + 1
        # the tokens on either side, where they are of the same text, hold tag 0
        before = (a > 0) & (text[a - 1] == text[a])
        after = (b < n) & (text[np.minimum(b, n - 1)] == text[b - 1])
        lo, length = a - before, b + after - a + before
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            s = scores[lo[mine, None] + np.arange(size)]
            s[before[mine], 0, 1:] = -1e9
            s[after[mine], -1, 1:] = -1e9
            tags[lo[mine, None] + np.arange(size)] |= self.viterbi(s)
        return tags


def likelihood(field: Field, x: np.ndarray, near: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mean negative log-likelihood of windows with an L2 penalty, and its gradient, by forward and backward sums.

    ``x``: n x length x features; ``near``: n x length x NEAR; ``y``: n x length.
    """
    n, length, width = x.shape
    kind = field.emit.dtype
    flat = x.reshape(-1, width).astype(kind, copy=False)
    s = flat @ field.emit
    for k, table in enumerate(field.words):
        s += table[near[:, :, k].reshape(-1)]
    s = s.reshape(n, length, 3)
    top = s.max(axis=2)
    e, move = np.exp(s - top[..., None]), np.exp(field.move)
    fwd, bwd, scale = np.empty_like(e), np.ones_like(e), np.empty_like(top)
    for t in range(length):  # scaled to sum to 1, so that long chains don't underflow
        now = e[:, t] * (fwd[:, t - 1] @ move) if t else e[:, 0]
        scale[:, t] = now.sum(axis=1)
        fwd[:, t] = now / scale[:, t, None]
    for t in range(length - 2, -1, -1):
        bwd[:, t] = (e[:, t + 1] * bwd[:, t + 1]) @ move.T / scale[:, t + 1, None]
    truth = np.eye(3, dtype=kind)[y]
    path = (s * truth).sum(axis=(1, 2)) + field.move[y[:, :-1], y[:, 1:]].sum(axis=1)
    loss = float((np.log(scale).sum(axis=1) + top.sum(axis=1) - path).mean() + decay / 2 * sum((w * w).sum() for w in (field.emit, field.words, field.move)))
    wrong = (fwd * bwd - truth).reshape(-1, 3)
    after = e[:, 1:] * bwd[:, 1:] / scale[:, 1:, None]
    edge = fwd[:, :-1].reshape(-1, 3).T @ after.reshape(-1, 3) * move
    seen = np.zeros((3, 3), kind)
    np.add.at(seen, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
    words = np.stack([np.stack([np.bincount(near[:, :, k].reshape(-1), wrong[:, c], HASHED + 1) for c in range(3)], axis=1) for k in range(len(NEAR))])
    return loss, (flat.T @ wrong / n + decay * field.emit, (words / n).astype(kind) + decay * field.words, (edge - seen) / n + decay * field.move)


def train(x: np.ndarray, near: np.ndarray, y: np.ndarray, *, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over all windows."""
    field = Field(np.zeros((x.shape[2], 3), np.float32), np.zeros((len(NEAR), HASHED + 1, 3), np.float32), np.zeros((3, 3), np.float32))
    x = x.astype(np.float32)
    weights = (field.emit, field.words, field.move)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, rounds + 1):
        _, grads = likelihood(field, x, near, y, decay)
        for w, g, (mean, square) in zip(weights, grads, state, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return field


def fit(docs: DataFrame, *, sample: int = 20_000, windows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field fitted to at most ``windows`` windows of the ``sample`` rows with the least hash of their id.

    None where the sample has no window. The ids of the sample are broadcast: there are ``sample`` at most.
    """
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    cheap = r"(?i)(passw|secret|token|api_?key)|AKIA[A-Z0-9]{8}|[0-9a-f]{24}"
    rows = rows.where(F.col("text").rlike(cheap) | (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(8)) == 0))
    got = rows.select("text").mapInArrow(_windows, "x binary, near binary, y binary").orderBy(F.xxhash64("x", "y"), "x", "near", "y").limit(windows).toArrow()
    length = 2 * REACH + 1
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), bool).reshape(-1, length, N_FEATURES)
    near = np.frombuffer(b"".join(got.column("near").to_pylist()), np.int16).reshape(-1, length, len(NEAR))
    y = np.frombuffer(b"".join(got.column("y").to_pylist()), np.int8).reshape(-1, length)
    return train(x, near, y)


def scan_texts(texts: list[bytes], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind) in code points of each text: the fixed patterns', and the field's where no pattern's span holds them."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    spans = base_spans(joined)
    if field is not None:
        starts, ends = tokens(data)
        if len(starts):
            text = np.searchsorted(edges, starts, "right") - 1
            hashes = word_hashes(data, starts, ends)
            tags = field.decode(field.scores(features(data, starts, ends, edges, hashes), neighbours(data, starts, ends, edges, hashes)), text)
            # an inside tag without a beginning starts a span too
            same = np.append(False, text[1:] == text[:-1])
            goes_on = (tags == 2) & same & np.append(False, tags[:-1] > 0)
            first = np.flatnonzero((tags > 0) & ~goes_on)
            last = np.flatnonzero((tags > 0) & ~np.append(goes_on[1:], False))
            # spans inside one of the patterns' are known: of the pattern spans that begin no later, the furthest end
            begins = np.array([a for a, _, _ in spans], np.int64)
            reach = np.maximum.accumulate(np.array([b for _, b, _ in spans], np.int64)) if spans else begins
            k = np.searchsorted(begins, starts[first], "right") - 1
            known = (k >= 0) & (reach[k] >= ends[last]) if spans else np.zeros(len(first), bool)
            spans = spans + [(int(a), int(b), 3) for a, b in zip(starts[first[~known]], ends[last[~known]], strict=True)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if spans:
        points = np.concatenate(([0], np.cumsum(B.code_points(data))))
        for a, b, kind in sorted(spans, key=lambda s: (s[0], s[2], s[1])):
            k = int(np.searchsorted(edges, a, "right")) - 1
            out[k].append((int(points[a] - points[edges[k]]), int(points[b] - points[edges[k]]), kind))
    return out


def find_secrets(docs: DataFrame, *, field: Field | None = None, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans) for each row of ``docs``.

    ``spans`` lists kind:start:end, comma-joined, by start and then kind; positions are code points, the end exclusive.
    ``base_sha256`` is the hash of that list without what the field adds.

    Defined cases: a null text counts as empty and has no spans; rows with equal or null ids are scanned each; an empty
    table gives an empty table; other columns are left out. Without a ``field`` one is fitted to ``docs``.
    """
    small_batches(docs.sparkSession)
    if field is None:
        field = fit(docs, sample=sample, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in B.pieces(batch.column("text")):
                raw, edges = data.tobytes(), offsets.tolist()
                found = scan_texts([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], field)
                counts = [pa.array([sum(k == kind for _, _, k in spans) for spans in found], pa.int64()) for kind in range(4)]
                listed = [[f"{KINDS[k]}:{a}:{b}" for a, b, k in spans] for spans in found]
                base = [",".join(x for x in one if not x.startswith("crf")) for one in listed]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([",".join(x) for x in listed])], ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)
