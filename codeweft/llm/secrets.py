"""Secret scans: a linear-chain conditional random field over tokens, decoded by Viterbi.

Tokens are runs of characters other than white space, quotes, brackets and separators. Each is tagged
begin (B), inside (I) or outside (O) of a secret by its shape, its neighbours' words and features of the
file: how much of the text is equals signs, braces and semicolons, or digits. The model is trained here, on
generated lines of configuration, code, prose and logs (`training_lines`), by maximum likelihood; training takes
no table, so it is the same everywhere and is done once in a driver.

The whole chain of every text is decoded. The field is constrained: a plain token (letters only, short, no key
word) can only be outside, in training and in decoding. So the best path is that of the runs of other tokens between
plain ones, each with its moves from and to outside at both ends; `forced_outside` checks that no transition
makes up for the constraint, and where one did, no token would count as plain. Runs of a slice are decoded
together, one token of each run at a time.

Base spans come from fixed patterns and are always reported. Null counts as empty; empty texts and tables
have no spans. Repeated rows and ids are scanned alike. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._common import bounded_batches, documents, text_of
from codeweft.llm._rolling import _LOWER, numbered, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
#: Bytes (lower case) of which a text with a match of ASSIGN has one.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

TAGS, B, I, O = ("B", "I", "O"), 0, 1, 2
DELIMITERS = " \t\n\v\f\r\"'`,;:()[]{}<>=|"
TOKEN = re.compile(rf"[^{re.escape(DELIMITERS)}]+=*")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "bearer", "api_key", "apikey", "key", "private", "credential")
#: Emission of a plain token, not learned.
PLAIN = (-60.0, -60.0, 0.0)
#: Features of a file, by bit: equals signs, braces and semicolons, digits; each with the characters and one in how many makes it hold.
FILE = (("config", "=", 40), ("code", "{};", 25), ("digits", "0123456789", 8))
RUN_BYTES, CACHE_TOKENS = 1 << 20, 200_000
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[list(DELIMITERS.encode())] = False
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_HEXDIGIT = np.zeros(256, dtype=bool)
_HEXDIGIT[list(b"0123456789abcdef")] = True
#: First two letters of the key words.
_OPENS = np.zeros(1 << 16, dtype=bool)
_OPENS[[w.encode()[0] << 8 | w.encode()[1] for w in KEYWORDS]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def key_word(token: str) -> int:
    """1 + the number of the key word that a token is, or 0."""
    word = token.lower().rstrip("=").strip("_-")
    return KEYWORDS.index(word) + 1 if word in KEYWORDS else 0


#: Letters of the Latin-1 block, all of which have a case.
_CASED = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,15}")
#: ASCII by kind: digits d, capitals u, small letters l, others r.
_KINDS = bytes(ord("d") if 48 <= c < 58 else ord("u") if 65 <= c < 91 else ord("l") if 97 <= c < 123 else ord("r") for c in range(256))


def kinds(token: str) -> str:
    if token.isascii():
        return token.encode().translate(_KINDS).decode()
    return "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "r" for c in token)


def shape(token: str) -> list[str]:
    """Features of a token by itself."""
    key = key_word(token)
    if not key and _CASED.fullmatch(token):
        return ["plain"]
    n, kind = len(token), kinds(token)
    digits, lower, upper = map(kind.count, "dlu")
    rest = n - digits - lower - upper
    if not digits and not rest and n < 16 and not key:
        return ["plain"]
    changes = len(re.findall("d+|u+|[lr]+", kind)) - 1
    out = [f"length{min(n, 48) // 8}", f"digits{0 if not digits else 1 + (digits * 4) // n}", f"changes{min(4, changes * 6 // n)}", f"distinct{min(5, len(set(token.lower())) // 4)}"]
    out += ["mixed"] * bool(digits and lower and upper) + ["hexlike"] * (n >= 12 and not re.search(r"[^0-9a-fA-F]", token))
    out += ["number"] * (digits == n) + ["dotted"] * ("." in token[:-1] or "@" in token) + ["odd"] * (rest > n // 3) + ["path"] * (token.count("/") > 1)
    return out + ["keyword"] * bool(key)


def beside(own: list[str], context: int, file: int) -> list[str]:
    """A token's features with its neighbours' words and the file. context: the key word before (from 1), else
    len(KEYWORDS) + 1 where there is one two tokens before, else 0."""
    if own == ["plain"]:
        return own
    prev = [] if not context else ["after2:key"] if context > len(KEYWORDS) else ["after:" + KEYWORDS[context - 1]]
    files = [name for k, (name, _, _) in enumerate(FILE) if file >> k & 1]
    return [*own, *prev, *(f"{x}&key" for x in own if prev and x.startswith(("length", "mixed"))), *files, *(f"{x}&{f}" for f in files for x in own if x.startswith("length"))]


def features(tokens: list[str], file: int) -> list[list[str]]:
    """Features of each token of a whole chain."""
    keys = [0, 0, *map(key_word, tokens)]
    return [beside(shape(t), keys[k + 1] or (len(KEYWORDS) + 1) * bool(keys[k]), file) for k, t in enumerate(tokens)]


def file_features(text: str) -> int:
    return sum((sum(map(text.count, chars)) * share > len(text)) << k for k, (_, chars, share) in enumerate(FILE))


def training_lines(n: int = 1200, seed: int = 3) -> list[tuple[list[str], list[int], int]]:
    """Generated (tokens, tags, features of the file)."""
    r = random.Random(seed)
    syllables = "an ber con del er fo gra hin ist jo ka len mi no or pa qui re sta tu un ver wo".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    chars = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    secret = lambda lo=20, hi=44: "".join(r.choices(chars[r.choice([*chars])], k=r.randint(lo, hi)))
    harmless = [
        lambda: str(r.randint(0, 10 ** r.randint(1, 16))), lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", lambda: f"{word()}_{word()}", lambda: f"{word()}.{r.randint(1, 99)}@{word()}.example.com",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"/{word()}/{word()}/{word()}", lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: word() + word() + word() + word() + word(), lambda: word().upper() + "!!", lambda: word() + r.choice(["$$$", "%%%", "&&&", "###", "***"]),
        lambda: "+1", lambda: f"555-{r.randint(1000, 9999)}", lambda: f"https//{word()}.org/{word()}/{word()}{r.randint(1, 99)}", lambda: f"{word()}-{word()}-{word()}",
    ]
    lines = []
    for _ in range(n):
        file, tokens, tags = sum((r.random() < p) << k for k, p in enumerate((0.3, 0.2, 0.2))), [], []
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(0, 5)):
                tokens.append(word() if r.random() < 0.75 else r.choice(harmless)())
                tags.append(O)
            kind = r.random() * (0.85 if file & 3 else 1.0)
            if kind < 0.35:
                tokens += [r.choice(["password", "secret", "token", "api_key", "TOKEN", "bearer", "private", "pwd"]), secret(12, 44)]
                tags += [O, B]
            elif kind < 0.5:
                tokens.append(secret(32, 64))
                tags.append(B)
            elif kind < 0.57:
                for k in range(r.randint(2, 3)):
                    tokens.append(secret(24, 40))
                    tags.append(I if k else B)
            elif kind < 0.7:
                tokens += [r.choice(["password", "token", "secret", "key"]), word()]
                tags += [O, O]
        if tokens:
            lines.append((tokens, tags, file))
    return lines


class Crf:
    """Weights for (feature, tag), (tag, tag) and the first tag."""

    def __init__(self, emit: dict[str, np.ndarray], move: np.ndarray, first: np.ndarray):
        self.emit, self.move, self.first = emit, move, first

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        none = np.zeros(3)
        return np.array([sum((self.emit.get(f, none) for f in fs), none) for fs in feats])

    def forced_outside(self) -> bool:
        """Whether a plain token's margin for outside exceeds all that its two transitions could make up for."""
        e = self.emit["plain"]
        spread = max(self.move.max() - self.move[:, O].min(), 0) + max(self.move.max() - self.move[O].min(), 0)
        return bool(e[O] - max(e[B], e[I]) > spread)

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        s = self.scores(feats)
        best, back = self.first + s[0], []
        for row in s[1:]:
            via = best[:, None] + self.move
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def train(lines: list[tuple[list[str], list[int], int]], rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Crf:
    """Maximum likelihood by full-batch Adagrad; all lines run through forward and backward together."""
    feats = [features(t, c) for t, _, c in lines]
    names = {f: k for k, f in enumerate(sorted({f for fs in feats for x in fs for f in x}))}
    longest = max(len(x) for x in feats)
    at, on, which = map(np.array, zip(*[(i, k, names[f]) for i, x in enumerate(feats) for k, fs in enumerate(x) for f in fs], strict=True))
    gold = np.full((len(lines), longest), -1)
    for i, (_, tags, _) in enumerate(lines):
        gold[i, : len(tags)] = tags
    real, rows = gold >= 0, np.arange(len(lines))
    last = real.sum(axis=1) - 1
    emit, move, first = np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)
    move[O, I] = first[I] = -4.0
    plain = names["plain"]
    emit[plain] = PLAIN
    squares = [np.full(x.shape, 1e-6) for x in (emit, move, first)]
    hot = np.eye(3)[np.maximum(gold, 0)] * real[..., None]
    soft = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
    for _ in range(rounds):
        s = np.zeros((len(lines), longest, 3))
        np.add.at(s, (at, on), emit[which])
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = first + s[:, 0]
        for k in range(1, longest):
            a[:, k] = soft(a[:, k - 1, :, None] + move, 1) + s[:, k]
        for k in range(longest - 2, -1, -1):
            b[:, k] = np.where(real[:, k + 1, None], soft(move + (s[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
        z = soft(a[rows, last], 1)
        p = np.exp(a + b - z[:, None, None]) * real[..., None]
        pair = np.exp(a[:, :-1, :, None] + move + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        gap = hot - p
        g = [np.zeros_like(emit), np.einsum("nki,nkj->ij", hot[:, :-1], hot[:, 1:]) - pair.sum(axis=(0, 1)), gap[:, 0].sum(axis=0)]
        np.add.at(g[0], which, gap[at, on])
        g[0][plain] = decay * len(lines) * emit[plain]
        for x, gx, q in zip((emit, move, first), g, squares, strict=True):
            gx -= decay * x * len(lines)
            q += gx * gx
            x += rate * gx / np.sqrt(q)
    return Crf({f: emit[k] for f, k in names.items()}, move, first)


@lru_cache(maxsize=1)
def model() -> Crf:
    return train(training_lines())


def whole_chain_spans(text: str, crf: Crf) -> list[tuple[int, int]]:
    """(start, end) of the secrets that one Viterbi over all tokens of text finds: what Scanner must give."""
    found = list(TOKEN.finditer(text))
    tags = crf.viterbi(features([t.group() for t in found], file_features(text))) if found else []
    out: list[list[int]] = []
    for k, (t, tag) in enumerate(zip(found, tags, strict=True)):
        if tag == B or (tag == I and (not k or tags[k - 1] == O)):
            out.append([t.start(), t.end()])
        elif tag == I:
            out[-1][1] = t.end()
    return [tuple(x) for x in out]


def run_tags(s: np.ndarray, begins: np.ndarray, sizes: np.ndarray, from_outside: np.ndarray, to_outside: np.ndarray, crf: Crf) -> np.ndarray:
    """The best path's tags of runs of tokens. s: scores of all runs' tokens, one run after the other; a run comes
    from outside or begins its text, and goes to outside or ends it."""
    order = np.argsort(-sizes, kind="stable")
    at, size = begins[order], sizes[order]
    best = np.where(from_outside[order][:, None], crf.move[O], crf.first) + s[at]
    back, last = [], np.zeros((len(order), 3))
    live = len(order)
    last[:] = best
    for k in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))  # runs longer than k
        via = best[:live, :, None] + crf.move
        back.append(via.argmax(axis=1))
        best = via.max(axis=1) + s[at[:live] + k]
        last[:live] = best
    end = (last + np.where(to_outside[order][:, None], crf.move[:, O], 0.0)).argmax(axis=1)
    tags = np.zeros(len(s), dtype=np.int64)
    now = np.zeros(len(order), dtype=np.int64)
    for k in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -k, side="left"))
        ended = size[:live] == k + 1
        now[:live] = np.where(ended, end[:live], now[:live])
        tags[at[:live] + k] = now[:live]
        if k:
            more = int(np.searchsorted(-size, -k, side="left"))
            now[:more] = back[k - 1][np.arange(more), now[:more]]
    return tags


class Scanner:
    """Scans slices of texts; a worker keeps the shapes of the first CACHE_TOKENS tokens, and scores by shape."""

    def __init__(self, crf: Crf):
        self.crf, self.forced = crf, crf.forced_outside()
        self.known: dict[bytes, int] = {}
        #: Distinct (features, key word) of tokens.
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[list[str]] = []
        self.keys: list[int] = []
        self.plain: list[bool] = []
        self.scores: dict[int, np.ndarray] = {}

    def types(self, tokens: list[bytes]) -> np.ndarray:
        """The number of each token's shape."""
        known, more = self.known, {}
        for t in tokens:
            if t not in known:
                text = t.decode()
                own = shape(text)
                key = (*own, key_word(text))
                number = self.numbers.setdefault(key, len(self.shapes))
                if number == len(self.shapes):
                    self.shapes.append(own)
                    self.keys.append(key[-1])
                    self.plain.append(self.forced and own == ["plain"])
                (known if len(known) < CACHE_TOKENS else more)[t] = number
        return np.fromiter((known[t] if t in known else more[t] for t in tokens), np.int64, len(tokens))

    def score(self, combination: int) -> np.ndarray:
        """The emission of a shape, a context and a file, packed into one number."""
        if combination not in self.scores:
            self.scores[combination] = self.crf.scores([beside(self.shapes[combination >> 8], combination >> 4 & 15, combination & 15)])[0]
        return self.scores[combination]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end in bytes) of the secrets in some whole texts, in order."""
        inside, n = _INSIDE[data], len(data)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = offsets[1:-1]
            before[cuts[cuts < n]] = False
            after[cuts[cuts > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        text = np.searchsorted(offsets, starts, side="right") - 1
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        plain = (letters[ends] - letters[starts] == ends - starts) & (ends - starts < 16)
        other = np.append(np.where(data != 61, np.arange(n), n), n)  # the next character that is not "="
        ends = np.minimum(np.minimum.accumulate(other[::-1])[::-1][ends], offsets[text + 1])
        low = _LOWER[np.append(data, 0)]
        wanted = ~plain | _OPENS[low[starts].astype(np.int64) << 8 | low[starts + 1]] | (data[np.minimum(ends, n) - 1] == 61)
        if not self.forced:
            wanted[:] = True
        some = np.flatnonzero(wanted)
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[starts[some]] += 1
        np.subtract.at(edge, ends[some], 1)
        which, tokens = numbered(data[np.cumsum(edge[:-1]) > 0], np.concatenate([[0], np.cumsum(ends[some] - starts[some])]))
        kind = np.zeros(len(starts), dtype=np.int64)
        kind[some] = self.types(tokens)[which]
        active, key = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=np.int64)
        if len(some):
            active[some], key[some] = ~np.array(self.plain)[kind[some]], np.array(self.keys)[kind[some]]
        same1, same2 = np.r_[False, text[1:] == text[:-1]], np.r_[False, False, text[2:] == text[:-2]][: len(text)]
        key1, key2 = np.r_[0, key[:-1]] * same1, np.r_[0, 0, key[:-2]][: len(key)] * same2
        context = np.where(key1 > 0, key1, (len(KEYWORDS) + 1) * (key2 > 0))
        file = np.zeros(len(offsets) - 1, dtype=np.int64)
        for k, (_, chars, share) in enumerate(FILE):
            table = np.zeros(256, dtype=np.int64)
            table[list(chars.encode())] = 1
            sums = np.concatenate([[0], np.cumsum(table[data])])
            file |= ((sums[offsets[1:]] - sums[offsets[:-1]]) * share > self.code_points(data, offsets)) << k
        run = np.flatnonzero(active)
        if not len(run):
            return (np.zeros(0, np.int64),) * 3
        every, back = np.unique(kind[run] << 8 | context[run] << 4 | file[text[run]], return_inverse=True)
        s = np.array([self.score(int(c)) for c in every])[back]
        fresh = np.r_[True, (np.diff(run) > 1) | (np.diff(text[run]) > 0)]
        begins = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begins, len(run)))
        first, final = run[begins], run[begins + sizes - 1]
        from_outside = np.r_[False, text[1:] == text[:-1]][first]
        to_outside = np.r_[text[1:] == text[:-1], False][final]
        tags = run_tags(s, begins, sizes, from_outside, to_outside, self.crf)
        goes_on = (tags == I) & ~fresh & np.r_[False, tags[:-1] != O]
        opens = np.flatnonzero((tags != O) & ~goes_on)
        closes = np.flatnonzero((tags != O) & ~np.r_[goes_on[1:], False])
        return text[run[opens]], starts[run[opens]], ends[run[closes]]

    @staticmethod
    def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def maybe_base(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may have base spans: all that do, and few others."""
    raw, found = data.tobytes(), []
    for words, body in ((ASSIGN_WORDS, raw.lower()), ((b"AKIA",), raw)):
        for w in words:
            at = body.find(w)
            while at >= 0:
                found.append(at)
                at = body.find(w, at + len(w))
    edges = np.flatnonzero(np.diff(np.r_[False, _HEXDIGIT[data], False].astype(np.int8)))
    long = edges[::2][edges[1::2] - edges[::2] >= 16]
    hits = np.concatenate([np.array(found, np.int64), long])
    # a run of hexadecimal digits may go over the end of a text: look at both
    ends = edges[1::2][edges[1::2] - edges[::2] >= 16] - 1
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[np.unique(np.searchsorted(offsets, hits, side="right") - 1)] = True
    for a, b in zip(np.searchsorted(offsets, long, side="right") - 1, np.searchsorted(offsets, ends, side="right") - 1, strict=True):
        out[a : b + 1] = True
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


_scanners: dict[int, Scanner] = {}


def _scanner(crf: Crf) -> Scanner:
    """One for each worker process and model."""
    key = zlib.crc32(b"".join([crf.move.tobytes(), crf.first.tobytes(), *(crf.emit[k].tobytes() for k in sorted(crf.emit))]))
    if key not in _scanners:
        _scanners[key] = Scanner(crf)
    return _scanners[key]


def _scan(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(crf)
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), RUN_BYTES):
                text, starts, ends = scanner.spans(data, offsets)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                more: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
                shift = points[offsets[:-1]]
                for t, a, b in zip(text.tolist(), points[starts].tolist(), points[ends].tolist(), strict=True):
                    more[t].append((a - int(shift[t]), b - int(shift[t])))
                counts, sha, spans, found = [[], [], []], [], [], []
                for t, look in enumerate(maybe_base(data, offsets).tolist()):
                    base = base_spans(data[offsets[t] : offsets[t + 1]].tobytes().decode("utf-8", "replace")) if look else []
                    taken = {(a, b) for a, _, b in base}
                    own = [x for x in more[t] if x not in taken]
                    for k in range(3):
                        counts[k].append(sum(x[1] == k for x in base))
                    sha.append(hashlib.sha256(joined([(a, KINDS[k], b) for a, k, b in base]).encode()).hexdigest())
                    spans.append(joined([(a, (*KINDS, "crf")[k], b) for a, k, b in sorted(base + [(a, 3, b) for a, b in own])]))
                    found.append(len(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans), pa.array(found, pa.int64())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """One row for each row of docs: counts by kind, the digest of base spans, and all spans (the model's as crf, but
    for those that a base span has exactly)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_scan(crf or model()), f"id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
    return out.withColumnRenamed("id", id_col)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
