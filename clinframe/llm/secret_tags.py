"""Secrets in texts: fixed patterns, and a linear-chain conditional random field beyond them.

The field tags tokens as begin, inside or outside of a secret. The score of a tag adds weights of the
token's shape and characters, of the words around it and of the kind of file; a 3 x 3 matrix scores
tags in a row. The best tags of a text are those of Viterbi's recurrence. Most tokens need none of
it: where "outside" leads by more than any change of two transitions can win back, the best tags
have "outside" there, so only the stretches between such tokens are decoded, with the same result.

Labels come from the texts themselves: tokens in a match of the fixed patterns are secrets. As a
corpus has few kinds of them, windows of its text also get statements with made secrets of further
kinds, and statements that only look alike. Fitting reads at most ``SAMPLE`` documents and
``SAMPLE_CHARS`` characters, in the order of a hash, in one task; tagging reads every text whole.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinframe.session import stored

#: The patterns, in the order of their names.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "tagged")

#: Documents that fitting may use, and their characters in all.
SAMPLE = 1000
SAMPLE_CHARS = 4_000_000
#: Hashed features; number 0 is nobody's and weighs nothing.
DIM = 1 << 16
#: Tokens of a window, and windows of plain text drawn from a document.
WINDOW, PLAIN = 16, 2
EPOCHS, RATE, DECAY = 50, 0.5, 1e-6
#: Characters of a text tokenised at once, and tokens whose scores a task remembers.
CHUNK, REMEMBERED = 400_000, 300_000
#: Least characters of a tagged secret.
LEAST = 6
BEGIN, INSIDE, OUTSIDE = range(3)

_TOKEN = re.compile(r"[^\W_]+(?:[+/._-]+[^\W_]+)*|[^\w\s]|_")
_SPACE = re.compile(r"\s")
_REPEAT = re.compile(r"(.)\1+", re.DOTALL)
_KEYWORDS = ("passw", "secret", "token", "api")
_CODE = "={};<>#"
_FILES = 12


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Matches (kind, start, end, start and end of the secret itself) by start, then kind."""
    found = []
    if ("=" in text or ":" in text) and any(word in (lower := text.lower()) for word in _KEYWORDS):
        del lower
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for k, pattern, least in ((1, ACCESS, ACCESS_LEAST), (2, HEX, 0)):
        found += [(m.start(), k, m.end(), *m.span()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return [(KINDS[k], start, end, a, b) for start, k, end, a, b in sorted(found)]


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        return "a" if chr(code).isalnum() else "s"


_CLASS = _Classes(
    {ord(c): "A" for c in string.ascii_uppercase} | {ord(c): "a" for c in string.ascii_lowercase} | {ord(c): "0" for c in string.digits}
    | {ord(c): c for c in "+/._-=:\"'"}
)
_KIND = ("symbol", "number", "hex", "HEX", "lower", "UPPER", "Title", "mixed", "lower9", "UPPER9", "all", "joined", "joined9")
_STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 40, 64)


def kind_of(token: str) -> int:
    if token.isalpha():
        name = "lower" if token.islower() else "UPPER" if token.isupper() else "Title" if token.istitle() else "mixed"
    elif len(token) == 1 and not token.isalnum():
        name = "symbol"
    elif token.isdigit():
        name = "number"
    elif not token.isalnum():
        name = "joined9" if any(c.isdigit() for c in token) else "joined"
    elif not set(token) - set("0123456789abcdef"):
        name = "hex"
    elif not set(token) - set("0123456789ABCDEF"):
        name = "HEX"
    else:
        name = "lower9" if token.lower() == token else "UPPER9" if token.upper() == token else "all"
    return _PLACE[name]


_PLACE = {name: k for k, name in enumerate(_KIND)}
_LOWER = _PLACE["lower"]
_NO_WORD = {_PLACE[k] for k in ("number", "hex", "HEX", "lower9", "UPPER9", "all", "joined9")}


def _number(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % (DIM - 1) + 1


def word_hash(token: str, kind: int) -> int:
    """Hash of what a token says: a short word in lower case without joiners, a mark, or its kind."""
    if kind == _LOWER and len(token) <= 16:
        return crc32(token.encode())
    if kind in _NO_WORD or len(token) > 16:
        return kind + 1
    return crc32((token.lower().replace("_", "").replace("-", "") or token).encode("utf-8", "surrogatepass"))


#: Places a word is seen from: its own token, those one to three behind it, and the one before it.
OWN, PLACES = 7, 5
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint64)


def word_numbers(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers (token, place) of words by their hashes; 0, the place beyond an end, has own
    numbers as well."""
    mixed = ((hashes.astype(np.uint64)[:, None] + np.uint64(1)) * _MIX) & np.uint64(0xFFFFFFFF)
    return np.maximum((mixed >> np.uint64(16)).astype(np.int32), 1)


def form_of(token: str, kind: int) -> tuple:
    """Everything the features of a token's form depend on."""
    size = bisect_right(_STEPS, len(token))
    if kind == _LOWER:
        return kind, size, "a", 0, "", 0
    head = token[:64]
    shape = _REPEAT.sub(r"\1", head.translate(_CLASS))[:12]
    if token.isalpha():
        return kind, size, shape, len(set(head)) // 3, "", 0
    return kind, size, shape, len(set(head)) // 3, token[:4], sum(map(str.isdigit, head)) * 6 // len(head)


def form_features(form: tuple) -> list[int]:
    kind, size, shape, distinct, start, digits = form
    name = _KIND[kind]
    names = [f"k{name}", f"l{name}{size}", f"s{shape[:10]}", f"t{len(shape)}.{size}", f"d{distinct}.{size}"]
    if start:
        names += [f"b{start}", f"e{name}{digits}.{size}"]
    return [_number(n) for n in names]


def file_bucket(text: str) -> int:
    """Marks of code per line, and length."""
    lines = text.count("\n") + 1
    marks = sum(text.count(c) for c in _CODE) / lines
    return 3 * ((marks >= 0.25) + (marks >= 1) + (marks >= 3)) + (len(text) >= 500) + (len(text) >= 5000)


def features(tokens: list[str], bucket: int) -> np.ndarray:
    """Numbers of all features of each token, filled up with 0."""
    kinds = [kind_of(t) for t in tokens]
    out = np.zeros((len(tokens), OWN + PLACES + 1), np.int32)
    for i, token in enumerate(tokens):
        own = form_features(form_of(token, kinds[i]))
        out[i, : len(own)] = own
        out[i, -1] = _number(f"f{bucket}{_KIND[kinds[i]]}")
    hashes = np.array([0, 0, 0, *map(word_hash, tokens, kinds), 0])
    numbers = word_numbers(hashes)
    for place, shift in enumerate(_SHIFTS):
        out[:, OWN + place] = numbers[shift : shift + len(tokens), place]
    return out


#: Where the word of each place lies in a row of tokens with three more before and one behind.
_SHIFTS = (3, 2, 1, 0, 4)


def _made_secret(rng: random.Random) -> str:
    pick = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    letters = string.ascii_letters + string.digits
    kind = rng.randrange(8)
    if kind == 0:
        return pick("0123456789abcdef", 24, 64)
    if kind == 1:
        return pick("0123456789ABCDEF", 24, 64)
    if kind == 2:
        return pick(letters + "+/", 24, 64) + "=" * rng.randrange(3)
    if kind == 3:
        return pick(letters, 16, 40)
    if kind == 4:
        return "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16)
    if kind == 5:
        return pick(string.ascii_lowercase, 2, 4) + rng.choice("_-") + pick(letters, 20, 40)
    if kind == 6:
        return pick(string.ascii_lowercase, 4, 8) + pick(string.digits, 2, 4) + pick(letters, 0, 3)
    return ".".join(pick(letters, 18, 30) for _ in range(3))


#: Words that announce a secret, and some that do not.
_ANNOUNCE = "password passwd pwd secret token api_key apikey access_key auth_token bearer client_secret private_key credential passphrase".split()
_HARMLESS = "color name city author version title order phone account invoice page date".split()


def _statement(rng: random.Random) -> tuple[str, int, int]:
    """A text, and where the secret in it is; harmless statements have none (-1)."""
    op = rng.choice([": ", " = ", "=", ":", " is ", " "])
    quote = rng.choice(["", '"', "'"])
    if rng.random() < 0.5:
        key, value = rng.choice(_ANNOUNCE), _made_secret(rng)
        key = rng.choice([key, key.upper(), key.title()])
        bare = rng.random() < 0.25 and len(value) >= 24
        before = quote if bare else key + op + quote
        return before + value + quote, len(before), len(before) + len(value)
    kind = rng.randrange(5)
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    if kind == 0:
        value = rng.choice(["red", "London", "required", "of", "reset", "Smith", "1.2.3", "true", "none"])
        return rng.choice(_ANNOUNCE + _HARMLESS) + op + quote + value + quote, -1, -1
    if kind == 1:
        return rng.choice(_HARMLESS) + op + quote + digits(rng.choice([4, 8, 11, 16])) + quote, -1, -1
    if kind == 2:
        return f"{rng.choice(_HARMLESS)}.{digits(2)}@mail{digits(1)}.example.com", -1, -1
    if kind == 3:
        return rng.choice(["DE", "GB", "FR"]) + digits(2) + rng.choice(["", "WEST", "BANK"]) + digits(14), -1, -1
    return f"https://www.{rng.choice(_HARMLESS)}.example.org/{rng.choice(_HARMLESS)}/{digits(4)}-{digits(2)}", -1, -1


def _tags(spans: list[tuple[int, int]], places: list[tuple[int, int]]) -> np.ndarray:
    tags = np.full(len(places), OUTSIDE, np.int8)
    for a, b in spans:
        inside = [i for i, (start, end) in enumerate(places) if start >= a and end <= b]
        tags[inside] = INSIDE
        if inside:
            tags[inside[0]] = BEGIN
    return tags


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (window, token, feature) and tags (window, token) to fit on."""
    rng = random.Random(11)
    numbers, tags = [], []

    def add(text: str, secrets: list[tuple[int, int]], center: int, bucket: int) -> None:
        low = max(0, center - 400)
        cut = text[low : center + 400]
        found = list(_TOKEN.finditer(cut))
        at = next((i for i, m in enumerate(found) if m.end() + low > center), 0)
        first = max(0, at - rng.randint(4, WINDOW - 5))
        near = found[max(0, first - 3) : first + WINDOW + 1]
        row = features([m.group() for m in near], bucket)[min(first, 3) :][:WINDOW]
        places = [(m.start() + low, m.end() + low) for m in found[first : first + WINDOW]]
        full = np.zeros((WINDOW, row.shape[1]), np.int32)
        full[: len(row)] = row
        tag = np.full(WINDOW, OUTSIDE, np.int8)
        tag[: len(row)] = _tags(secrets, places)
        numbers.append(full)
        tags.append(tag)

    for text in texts:
        bucket = file_bucket(text)
        secrets = [(a, b) for *_, a, b in base_spans(text)]
        for a, _ in secrets[:20]:
            add(text, secrets, a, bucket)
        odd = [m.start() for m in _TOKEN.finditer(text[:20000]) if _KIND[kind_of(m.group())] not in ("lower", "Title", "symbol")]
        for at in rng.sample(odd, min(PLAIN, len(odd))) + [rng.randrange(len(text) + 1) for _ in range(PLAIN)]:
            add(text, secrets, at, bucket)
        for _ in range(PLAIN):
            at = rng.randrange(len(text) + 1)
            made, a, b = _statement(rng)
            head, tail = text[max(0, at - 400) : at], text[at : at + 400]
            new = f"{head} {made}{rng.choice([' ', '. ', chr(10), ', '])}{tail}"
            shift = len(head) + 1
            add(new, [(a + shift, b + shift)] if a >= 0 else [], shift + max(a, 0), bucket)
    if not numbers:
        return np.zeros((0, WINDOW, 1), np.int32), np.zeros((0, WINDOW), np.int8)
    return np.stack(numbers), np.stack(tags)


def _sums(x: np.ndarray) -> np.ndarray:
    """log(sum(exp(x))) over the last axis."""
    top = x.max(axis=-1)
    return top + np.log(np.exp(x - top[..., None]).sum(axis=-1))


def fit(texts: list[str]) -> bytes:
    """Weights (``DIM`` x 3, then 3 x 3) by Adagrad on the windows' conditional log-likelihood. A
    window stands between two tags "outside"."""
    weights, moves = np.zeros((DIM, 3)), np.zeros((3, 3))
    weights[0] = 0
    numbers, tags = _windows(texts)
    n = len(numbers)
    if n:
        flat = numbers.reshape(n * WINDOW, -1)
        real = np.eye(3)[tags.astype(int)]
        # Tags in a row as they are, with the two that enclose a window.
        ends = np.zeros((n, 1, 3))
        ends[:, 0, OUTSIDE] = 1
        seen_moves = np.einsum("wti,wtj->ij", np.concatenate([ends, real], 1), np.concatenate([real, ends], 1))
        squares, squares_moves = np.full((DIM, 3), 1e-3), np.full((3, 3), 1e-3)
        for _ in range(EPOCHS):
            score = weights[flat].sum(axis=1).reshape(n, WINDOW, 3)
            ahead, behind = np.empty((WINDOW, n, 3)), np.empty((WINDOW, n, 3))
            ahead[0] = moves[OUTSIDE] + score[:, 0]
            for t in range(1, WINDOW):
                ahead[t] = _sums(ahead[t - 1][:, None, :] + moves.T[None]) + score[:, t]
            behind[-1] = moves[:, OUTSIDE]
            for t in range(WINDOW - 2, -1, -1):
                behind[t] = _sums(moves[None] + (score[:, t + 1] + behind[t + 1])[:, None, :])
            total = _sums(ahead[-1] + behind[-1])
            share = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2)
            expected = np.zeros((3, 3))
            for t in range(WINDOW - 1):
                both = ahead[t][:, :, None] + moves[None] + (score[:, t + 1] + behind[t + 1])[:, None, :]
                expected += np.exp(both - total[:, None, None]).sum(axis=0)
            expected[OUTSIDE] += share[:, 0].sum(axis=0)
            expected[:, OUTSIDE] += share[:, -1].sum(axis=0)
            gap = (share - real).reshape(n * WINDOW, 3)
            slope = np.stack(
                [np.bincount(flat.ravel(), np.repeat(gap[:, k], flat.shape[1]), DIM) for k in range(3)], axis=1
            ) / n + DECAY * weights
            slope[0] = 0
            slope_moves = (expected - seen_moves) / n
            squares += slope**2
            squares_moves += slope_moves**2
            weights -= RATE * slope / np.sqrt(squares)
            moves -= RATE * slope_moves / np.sqrt(squares_moves)
    return weights.astype(np.float32).tobytes() + moves.astype(np.float32).tobytes()


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """Weights fitted on a sample of ``docs``: the first in the order of a hash of the id. Null ids
    and texts are left out; the weights of an empty table are zero, which tag nothing."""
    at = F.xxhash64(doc_id)
    named = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), at.alias("at"))
    chosen = stored(named.select("at", "id").distinct().orderBy("at", "id").limit(SAMPLE))
    rows = named.join(F.broadcast(chosen), ["at", "id"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, room = [], SAMPLE_CHARS
        for batch in batches:
            for value in batch.column("text"):
                one = value.as_py()
                if len(one) <= room:
                    room -= len(one)
                    texts.append(one)
        yield pa.RecordBatch.from_pydict({"weights": [fit(texts)]})

    ordered = rows.select("text", "at", "id").repartition(1).sortWithinPartitions("at", "id", "text")
    found = ordered.mapInArrow(fitted, "weights binary").first()
    return found["weights"] if found else fit([])


def viterbi(score: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a stretch of tokens between two that are outside."""
    best = moves[OUTSIDE] + score[0]
    back = []
    for row in score[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tag = int((best + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return tags[::-1]


class Tagger:
    """Tags texts; remembers what each token adds to its own score and to its neighbours'."""

    def __init__(self, weights: bytes):
        values = np.frombuffer(weights, np.float32)
        self.weights, self.moves = values[:-9].reshape(DIM, 3), values[-9:].reshape(3, 3).astype(np.float64)
        # What a tag can win at most over "outside" by the transitions to it and from it.
        into, out = self.moves - self.moves[:, [OUTSIDE]], self.moves - self.moves[[OUTSIDE]]
        self.lead = (into.max(axis=0) + out.max(axis=1))[:OUTSIDE].astype(np.float32) + np.float32(1e-3)
        self.fitted = bool(values.any())
        self.files = np.stack([[self.weights[_number(f"f{b}{k}")] for k in _KIND] for b in range(_FILES)])
        self.forget()

    def forget(self) -> None:
        """Row 0 stands for the place beyond an end of a text."""
        self.rows: dict[str | None, int] = {None: 0}
        self.parts = np.zeros((1024, PLACES, 3), np.float32)
        self.parts[0] = self.weights[word_numbers(np.zeros(1, np.int64))[0]]
        self.kinds = np.zeros(1024, np.int8)
        self.forms: dict[tuple, np.ndarray] = {}
        forms = [(_LOWER, size, "a", 0, "", 0) for size in range(len(_STEPS) + 1)]
        self.lower = np.stack([self.weights[form_features(form)].sum(axis=0) for form in forms])

    def learn(self, tokens: set[str]) -> None:
        """Rows of new tokens; words in lower case, most of them, are taken together."""
        words = [t for t in tokens if t.isalpha() and t.islower()]
        others = list(tokens.difference(words))
        kinds = list(map(kind_of, others))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        hashes = np.fromiter(map(crc32, map(str.encode, words)), np.int64, len(words))
        hashes = np.append(np.where(sizes <= 16, hashes, _LOWER + 1), np.array(list(map(word_hash, others, kinds)), np.int64))
        own = np.empty((len(hashes), 3), np.float32)
        own[: len(words)] = self.lower[np.searchsorted(_STEPS, sizes, "right")]
        for i, form in enumerate(map(form_of, others, kinds), len(words)):
            value = self.forms.get(form)
            if value is None:
                value = self.forms[form] = self.weights[form_features(form)].sum(axis=0)
            own[i] = value
        first = len(self.rows)
        last = first + len(hashes)
        while last > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        self.kinds[first : first + len(words)] = _LOWER
        self.kinds[first + len(words) : last] = kinds
        self.parts[first:last] = self.weights[word_numbers(hashes)]
        self.parts[first:last, 0] += own
        self.rows.update(zip(words + others, range(first, last), strict=True))

    def _scores(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the tokens that may be in a secret, and their scores."""
        bucket, at, done = file_bucket(text), 0, 0
        carried: list[str | None] = [None] * 3
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                space = _SPACE.search(text, at + CHUNK)
                end = space.start() if space else end
            tokens = carried + _TOKEN.findall(text, at, end)
            last = end >= len(text)
            at = end
            if last:
                tokens.append(None)
            if len(self.rows) > REMEMBERED:
                self.forget()
            new = set(tokens).difference(self.rows)
            if new:
                self.learn(new)
            ids = np.fromiter(map(self.rows.__getitem__, tokens), np.int32, len(tokens))
            count = len(ids) - 4
            if count <= 0:
                carried = tokens
                continue
            score = self.files[bucket][self.kinds[ids[3 : 3 + count]]]
            for place, shift in enumerate(_SHIFTS):
                score += self.parts[ids[shift : shift + count], place]
            keep = np.flatnonzero((score[:, OUTSIDE] <= (score[:, :OUTSIDE] + self.lead).max(axis=1)))
            yield keep + done, score[keep]
            done += count
            carried = tokens[-4:]

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """Spans of tagged tokens. A run of inside tags without a begin starts one too."""
        if not self.fitted:
            return []
        found = list(self._scores(text))
        if not found:
            return []
        at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        marked: dict[int, int] = {}
        score = score.astype(np.float64)
        starts = np.append(0, np.flatnonzero(np.diff(at) > 1) + 1)
        ends = np.append(starts[1:], len(at))
        alone = starts[ends - starts == 1]
        tags = (score[alone] + self.moves[OUTSIDE] + self.moves[:, OUTSIDE]).argmax(axis=1)
        marked.update(zip(at[alone[tags != OUTSIDE]].tolist(), tags[tags != OUTSIDE].tolist(), strict=True))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                tags = viterbi(score[a:b], self.moves)
                marked.update((place, tag) for place, tag in zip(at[a:b].tolist(), tags, strict=True) if tag != OUTSIDE)
        if not marked:
            return []
        spans: list[list[int]] = []
        last = max(marked)
        before = -2
        for i, m in enumerate(_TOKEN.finditer(text)):
            if i in marked:
                if marked[i] == INSIDE and before == i - 1 and m.start() == spans[-1][1]:
                    spans[-1][1] = m.end()
                else:
                    spans.append([m.start(), m.end()])
                before = i
            if i >= last:
                break
        return [(a, b) for a, b in spans if b - a >= LEAST]

    def scan(self, text: str | None) -> list[dict]:
        """All spans by start, then kind; tagged ones that a pattern's span covers are left out."""
        text = text or ""
        spans = [dict(zip(("kind", "start", "end", "secret_start", "secret_end"), s, strict=True)) for s in base_spans(text)]
        for a, b in self.secrets(text):
            if not any(s["start"] <= a and b <= s["end"] for s in spans if s["kind"] != "tagged"):
                spans.append({"kind": "tagged", "start": a, "end": b, "secret_start": a, "secret_end": b})
        return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))


_SPAN = "struct<kind: string, start: long, end: long, secret_start: long, secret_end: long>"


def scan(docs: DataFrame, weights: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: spans in code points (end exclusive) of whole matches and of the
    secrets in them.

    Null and empty texts have none, repeated rows have the same, an empty table stays empty. An own
    column ``secrets`` is replaced, all others stay. No shuffle; the weights, under 1 MB, go to
    every executor.
    """
    given = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(f"array<{_SPAN}>")
    def scanned(texts: pa.Array) -> pa.Array:
        tagger = Tagger(given.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "secret_start", "secret_end")]]))
        return pa.array([tagger.scan(v.as_py()) for v in texts], kind)

    return docs.withColumn("secrets", scanned(F.col(text)))
