"""Problem 5: personal data inside free text, found by a character-level bidirectional LSTM with CRF transitions.

The network is plain numpy. Texts are cut into sentences and lines; longer ones get overlapping
windows whose scores are blended, and one Viterbi pass over the whole stretch reconciles them.
Sentences that were read before, and they are many in any corpus, are looked up. What is found is
checked exactly against the shape of its kind, and trimmed of labels and punctuation.

The cell couples its input and forget gates (one is what the other leaves) and its gates are straight
between 0 and 1, so that a step is one product and few passes. Steps from a tag to "nothing" or to
the beginning of a kind cost what leaving the one and entering the other cost; inside a kind only
its own tags follow. So Viterbi needs a maximum per step instead of a table of tags by tags.
"""

from __future__ import annotations

import io
import pkgutil
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "ssn", "id_number", "credit_card", "ipv4", "address", "name")
#: Nothing, then the beginning of each kind, then its inside.
TAGS = ("O", *(f"B-{k}" for k in KINDS), *(f"I-{k}" for k in KINDS))
FIRST_INSIDE = 1 + len(KINDS)
#: Characters of a window, and those that neighbouring windows share.
WINDOW, OVERLAP = 160, 64
#: Windows that go through the network together.
BATCH = 1024
#: Texts read together.
TEXTS = 2048
#: Sentences that a worker remembers: those of the last reads, and as many from before.
KEEP = 150_000
WEIGHTS = "pii_weights.npz"

# A stretch ends at a line's end, after a Chinese full stop, after a tag, or after a sentence's mark that
# follows a word of four letters or more, as abbreviations are shorter, and comes before a capital or a tag.
# Every branch begins with one of the signs, so the search leaps to those.
_CUT = re.compile(
    r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029。！？>.!?](?:(?<=[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=[。！？])(?=[^\n])"
    r"|(?<=>)(?=[^\W\d_a-z])|(?<=[^\W\d_]{4}[.!?])(?:(?=<)| (?=[^\W\d_a-zß-ÿ])))"
)
# tanh between -1 and 1, where a cell's content stays, as the fraction x (x^4 + 105 x^2 + 945) / (15 x^4 + 420 x^2 + 945), right to
# 5e-8: over y = x^2 + 14 it is x STATE ((y - LESS) / (y^2 - 133) + 1 / 77). The factor STATE is in the weights that a state meets.
STATE, LESS = 77 / 15, 14 - 882 / 77


@dataclass
class Network:
    """chars: the known characters, by place; 0 is any other. Weights of both directions, tags and transitions.

    w, u, b: per direction, input, state and bias of the three gates keep-or-take, output and content.
    leave, enter: of a step from any tag to "nothing" or a beginning; begun, inside: of a step to a
    kind's inside from its beginning and from its inside.
    """

    chars: dict[str, int]
    embed: np.ndarray
    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    leave: np.ndarray
    enter: np.ndarray
    begun: np.ndarray
    inside: np.ndarray

    def __post_init__(self) -> None:
        # a gate is x/4 + 1/2 between 0 and 1; the quarter and the half go into the weights, as do the content's 2 of tanh x = 1 - 2 / (e^2x + 1)
        hidden = self.u[0].shape[0]
        scale = np.r_[np.full(2 * hidden, 0.25), np.full(hidden, 2.0)].astype(np.float32)
        shift = np.r_[np.full(2 * hidden, 0.5), np.zeros(hidden)].astype(np.float32)
        # rows in the order in which a step reads them: forward the state, 1 and the letter; backward the letter, 1 and the state
        parts = [[u * np.float32(STATE), (b + shift / scale)[None], w] for w, u, b in zip(self.w, self.u, self.b)]
        self.gates = [np.ascontiguousarray((np.concatenate(x) * scale).T) for x in (parts[0], parts[1][::-1])]
        self.letters = np.ascontiguousarray(self.embed.T)
        out = self.out * np.float32(STATE)
        self.read_out = np.ascontiguousarray(np.concatenate([out[hidden:], out[:hidden], self.bias[None]]).T)
        self.places = np.full(0x110000, -1, dtype=np.int32)
        self.room = np.empty(0, dtype=np.float32)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """The places of the texts' characters, end to end."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        places = self.places[points]
        if (new := np.unique(points[places < 0])).size:
            self.places[new] = [code(chr(c), self.chars) for c in new.tolist()]
            places = self.places[points]
        return places

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tag scores (time, tag, text) of padded texts (time, text), longest first; beyond a text's end they mean nothing."""
        t_max, n = ids.shape
        hidden, wide = self.u[0].shape[0], self.embed.shape[1]
        one, back, ahead = wide, wide + 1, wide + 1 + hidden
        rows = 2 * ahead
        if self.room.size < (t_max + 2) * rows * n:
            self.room = np.zeros((t_max + 2) * rows * n, dtype=np.float32)
        # fed[t + 1] has both states after step t side by side, and beyond each 1 and the letter that its direction reads next
        fed = self.room[: (t_max + 2) * rows * n].reshape(t_max + 2, rows, n)
        for e in range(wide):
            letters = np.take(self.letters[e], ids)
            fed[2:, e], fed[:-2, ahead + hidden + 1 + e] = letters, letters
        fed[:, one] = fed[:, ahead + hidden] = 1
        fed[0, ahead : ahead + hidden] = 0
        alive = [*alive_at(lengths, t_max), 0]
        room, spare = np.empty(3 * hidden * n, np.float32), np.empty(hidden * n, np.float32)
        for way in (0, 1):
            weights = self.gates[way]
            cell = np.zeros((hidden, n), np.float32)
            for t in range(t_max) if way == 0 else range(t_max - 1, -1, -1):
                k = alive[t]
                if way == 1:
                    fed[t + 2, back:ahead, alive[t + 1] : k] = 0  # texts that end here
                gates, old = room[: 3 * hidden * k].reshape(3 * hidden, k), spare[: hidden * k].reshape(hidden, k)
                np.matmul(weights, fed[t + 2, :ahead, :k] if way else fed[t, ahead:, :k], out=gates)
                take, give, content = gates[:hidden], gates[hidden : 2 * hidden], gates[2 * hidden :]
                np.clip(gates[: 2 * hidden], 0, 1, out=gates[: 2 * hidden])
                tanh_of_half(content)
                held = cell[:, :k]
                np.subtract(content, held, out=old)
                old *= take
                held += old
                state_of(held, old, content)
                np.multiply(old, give, out=fed[t + 1, back:ahead, :k] if way else fed[t + 1, ahead : ahead + hidden, :k])
        return np.matmul(self.read_out, fed[1:-1, back : ahead + hidden + 1])

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts for which some run of tags outscores "nothing here", and their best tags (time, text), by Viterbi.

        scores is (time, tag, text), texts longest first; it is overwritten by the best sums.
        """
        t_max, _, n = scores.shape
        one = FIRST_INSIDE
        leave, enter, begun, inside = self.leave[:, None], self.enter[:, None], self.begun[:, None], self.inside[:, None]
        best = scores[0]
        calm = np.empty((t_max, n), np.float32)  # the sums of "nothing" throughout, added up as the others are
        best[:one] += enter
        best[one:] = -1e9
        calm[0] = best[0]
        for t, k in enumerate(alive_at(lengths, t_max)):
            if not t:
                continue
            before, now = scores[t - 1, :, :k], scores[t, :, :k]
            calm[t, :k] = now[0] + ((calm[t - 1, :k] + self.leave[0]) + self.enter[0])
            now[:one] += (before + leave).max(axis=0) + enter
            now[one:] += np.maximum(before[1:one] + begun, before[one:] + inside)
        rows = np.arange(n)
        loud = np.nonzero(scores[lengths - 1, :, rows].max(axis=1) > calm[lengths - 1, rows])[0]
        if not len(loud):
            return loud, np.zeros((t_max, 0), np.int64)
        ends = lengths[loud]
        mine = np.ascontiguousarray(scores[: ends[0], :, loud].transpose(0, 2, 1))
        left = (mine + self.leave).argmax(axis=2)
        fresh = mine[:, :, 1:one] + self.begun >= mine[:, :, one:] + self.inside
        tags = np.zeros((int(ends[0]), len(loud)), dtype=np.int64)
        rows = np.arange(len(loud))
        tags[ends - 1, rows] = mine[ends - 1, rows].argmax(axis=1)
        for t in range(int(ends[0]) - 1, 0, -1):
            tag = tags[t]
            k = np.maximum(tag - one, 0)
            came = np.where(tag < one, left[t - 1], np.where(fresh[t - 1, rows, k], k + 1, tag))
            tags[t - 1] = np.where(t < ends, came, tags[t - 1])
        return loud, tags


def tanh_of_half(x: np.ndarray) -> None:
    """tanh of the half of x, in its place; a power of e that overflows gives 1."""
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1


def state_of(x: np.ndarray, out: np.ndarray, room: np.ndarray) -> None:
    """tanh x / STATE for x between -1 and 1; room is overwritten."""
    np.multiply(x, x, out=out)
    out += 14
    np.multiply(out, out, out=room)
    room -= 133
    out -= LESS
    out /= room
    out += 1 / 77
    out *= x


def alive_at(lengths: np.ndarray, steps: int) -> list[int]:
    """How many of the texts, longest first, still run at each step."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()


def code(c: str, chars: dict[str, int]) -> int:
    """The place of a character; an accented letter falls back on its base, a Chinese one on 一."""
    if c in chars:
        return chars[c]
    base = unicodedata.normalize("NFKD", c)[0]
    if base in chars:
        return chars[base]
    if "㐀" <= c <= "鿿":
        return chars.get("一", 0)
    return chars.get("ø" if c.isalpha() else " " if c.isspace() else "§", 0)


def load(data: bytes) -> Network:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        chars = {c: i + 1 for i, c in enumerate("".join(map(chr, z["chars"])))}
        get = lambda k: z[k].astype(np.float32)
        return Network(chars, get("embed"), [get("w0"), get("w1")], [get("u0"), get("u1")], [get("b0"), get("b1")], *map(get, ("out", "bias", "leave", "enter", "begun", "inside")))


def stretches(text: str) -> list[tuple[int, str]]:
    """(start, text) of the sentences and lines, blanks at their ends left out."""
    out: list[tuple[int, str]] = []
    at = 0
    ends = [m.end() for m in _CUT.finditer(text)]
    ends.append(len(text))
    for end in ends:
        part = text[at:end]
        if body := part.strip():
            out.append((at if body[0] == part[0] else at + len(part) - len(part.lstrip()), body))
        at = end
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for i in np.nonzero(tags)[0].tolist():
        inside = tags[i] >= FIRST_INSIDE
        kind = KINDS[tags[i] - (FIRST_INSIDE if inside else 1)]
        if inside and out and out[-1][1] == i and out[-1][2] == kind:
            out[-1] = (out[-1][0], i + 1, kind)
        else:
            out.append((i, i + 1, kind))
    return out


class Reader:
    """Reads stretches of text in batches; remembers what it has read."""

    def __init__(self, network: Network) -> None:
        self.network, self.seen, self.older = network, {}, {}

    def read(self, texts: Sequence[str]) -> None:
        """Fill ``seen`` with the spans of these texts: all windows of similar length go through the network together."""
        net = self.network
        if not texts:
            return
        self.seen |= dict.fromkeys(texts, ())
        places = net.encode(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        short, long = np.flatnonzero(sizes <= WINDOW), np.flatnonzero(sizes > WINDOW).tolist()
        # length, text, start in the text, place of its first character
        windows = [(min(WINDOW, sizes[k] - at), k, at, begins[k] + at) for k in long for at in range(0, sizes[k] - OVERLAP, WINDOW - OVERLAP)]
        table = np.concatenate([np.column_stack([sizes[short], short, np.zeros_like(short), begins[short]]), np.array(windows, np.int64).reshape(-1, 4)])
        table = table[np.argsort(-table[:, 0], kind="stable")]
        blended: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at in range(0, len(table), BATCH):
            lengths, which, starts, firsts = table[at : at + BATCH].T
            steps = np.arange(lengths[0])[:, None]
            ids = places[np.where(steps < lengths, steps + firsts, 0)]
            with np.errstate(over="ignore"):
                got = net.emissions(ids, lengths)
            for i in np.nonzero(sizes[which] > WINDOW)[0].tolist():
                k = int(which[i])
                self._blend(blended, texts[k], k, int(starts[i]), got[: lengths[i], :, i])
            loud, tags = net.decode(got, lengths)
            for column, i in enumerate(loud.tolist()):
                text = texts[which[i]]
                if len(text) <= WINDOW:
                    self.seen[text] = self._checked(text, tags[: len(text), column])
        long.sort(key=lambda k: -len(texts[k]))
        for at in range(0, len(long), 64):
            batch = [texts[k] for k in long[at : at + 64]]
            lengths = np.array([len(t) for t in batch])
            scores = np.zeros((lengths[0], len(TAGS), len(batch)), np.float32)
            for j, k in enumerate(long[at : at + 64]):
                scores[: lengths[j], :, j] = blended[k][0] / blended[k][1][:, None]
            loud, tags = net.decode(scores, lengths)
            for column, j in enumerate(loud.tolist()):
                self.seen[batch[j]] = self._checked(batch[j], tags[: lengths[j], column])

    @staticmethod
    def _blend(blended: dict[int, tuple[np.ndarray, np.ndarray]], text: str, k: int, start: int, scores: np.ndarray) -> None:
        """Add a window's scores, weighed by the distance from its edges."""
        size = len(scores)
        if k not in blended:
            blended[k] = np.zeros((len(text), len(TAGS)), np.float32), np.zeros(len(text), np.float32)
        edge = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(np.float32)
        blended[k][0][start : start + size] += scores * edge[:, None]
        blended[k][1][start : start + size] += edge

    @staticmethod
    def _checked(text: str, tags: np.ndarray) -> tuple[tuple[int, int, str], ...]:
        return tuple(x for s in spans_of(tags) if (x := check(text, *s)))

    def find(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) in each text, in order."""
        parts = [stretches(t) if t else [] for t in texts]
        new = dict.fromkeys(s for p in parts for _, s in p if s not in self.seen)
        self.seen |= {s: self.older[s] for s in new if s in self.older}
        self.read([s for s in new if s not in self.seen])
        seen = self.seen
        found = [[(at + a, at + b, kind) for at, s in p for a, b, kind in seen[s]] for p in parts]
        if len(seen) > KEEP:
            self.older, self.seen = seen, {}
        return found


# ---------------------------------------------------------------- exact checks

_LABEL = re.compile(r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Mme|Frau|Herr|Sra?|Dra?)\.? |mailto:|tel:|[\"'“„«<(\[{]+)+", re.I)
# An address is written with its sign, with a bracketed word for it, or spelled out, and then its dots are spelled out too.
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)"
_EMAIL = re.compile(
    rf"[A-Za-z0-9_.+%-]+(?:[@＠]| @ |\s?(?:\[at\]|\(at\)|\{{at\}})\s?)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9_.+%-]+(?: dot [A-Za-z0-9_+%-]+)*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+",
    re.I,
)
_IP = re.compile(r"(?:\d{1,3}(?:\.|\[\.\])){3}\d{1,3}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_GROUPS = re.compile(r"[+(]?\d[\d ().\-/]*\d")


def check(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The span within its stretch, snapped to the shape of its kind; None if it can't be of that kind.

    Digits shaped like an address of the network are one, and three, two and four of them joined by
    hyphens are no telephone number, whichever number they were taken for. A telephone number has 7 to
    15 digits, a card's 13 to 19, an SSN 9, an address one or more; a name has two to eight words
    (a Chinese one two characters or more), an address at most 160 characters.
    """
    if kind in ("phone", "ssn", "credit_card", "id_number"):
        kind = "ipv4" if _IP.fullmatch(text[start:end].strip(" .")) else "ssn" if kind == "phone" and _SSN.fullmatch(text[start:end].strip()) else kind
    if kind in ("email", "ipv4", "phone", "ssn", "credit_card"):
        pattern = {"email": _EMAIL, "ipv4": _IP}.get(kind, _GROUPS)
        best = None
        for m in pattern.finditer(text, max(0, start - 24)):
            if m.start() >= end:
                break
            shared = min(end, m.end()) - max(start, m.start())
            if shared > 0 and (best is None or shared > best[0]):
                best = (shared, m.start(), m.end())
        if best is None:
            return None
        a, b = best[1:]
        if text[a] == "(" and ")" not in text[a:b]:
            a += 1
        digits = sum(c.isdigit() for c in text[a:b])
        if kind == "email":
            while b > a and text[b - 1] in "._-":
                b -= 1
        if kind == "phone" and not 7 <= digits <= 15 or kind == "ssn" and digits != 9 or kind == "credit_card" and not 13 <= digits <= 19:
            return None
        if kind == "ipv4" and any(int(x) > 255 for x in re.findall(r"\d+", text[a:b])):
            return None
        return a, b, kind
    while start > 0 and text[start - 1].isalnum() and text[start].isalnum() and text[start] < "㐀" and text[start - 1] < "㐀":
        start -= 1
    while end < len(text) and text[end].isalnum() and text[end - 1].isalnum() and text[end] < "㐀" and text[end - 1] < "㐀":
        end += 1
    if m := _LABEL.match(text[start:end]):
        start += m.end()
    while end > start and (text[end - 1] in " ,;:!?\"'”“»>)]}，；。：！？、*_`" or text[end - 1] == "." and not re.search(r"\b[A-Z]\.$", text[start:end])):
        end -= 1
    while start < end and text[start] in " ,;:*_`":
        start += 1
    surface = text[start:end]
    if kind == "id_number" and sum(c.isdigit() for c in surface) < 5:
        return None
    if kind == "name" and " " not in surface.strip() and not "㐀" <= surface[:1] <= "鿿":
        return None  # a single word alone isn't a person's name
    if kind == "name" and len(surface.split()) > 8 or kind == "address" and len(surface) > 160:
        return None
    if kind == "address" and not any(c.isdigit() for c in surface) or kind == "name" and (any(c.isdigit() or c in "@<>{}|\\" for c in surface) or len(surface) < 2):
        return None
    return start, end, kind


# ---------------------------------------------------------------- the operators

_READERS: dict[int, Reader] = {}


def _reader(data: bytes) -> Reader:
    key = hash(data)
    if key not in _READERS:
        _READERS[key] = Reader(load(data))
    return _READERS[key]


def weights() -> bytes:
    """The trained weights that come with the package; pii_train makes them."""
    data = pkgutil.get_data(__package__, WEIGHTS)
    if data is None:
        raise FileNotFoundError(WEIGHTS)
    return data


def personal_data(rows: DataFrame, key: str, text: str, data: bytes | None = None) -> DataFrame:
    """(key, kind, surface): the different pieces of personal data of each row's text, as they stand there.

    A null, empty or blank text has none. Repeated rows and rows with the same key and text give the
    same pieces once; a null key is kept. Other columns are ignored. Texts are read whole, however long.
    """
    trained = data or weights()
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(trained)
        for frame in frames:
            for at in range(0, len(frame), TEXTS):
                part = frame.iloc[at : at + TEXTS]
                found = reader.find(part["_text"].tolist())
                out = [(k, what, t[a:b]) for k, t, spans in zip(part["_key"], part["_text"], found) for a, b, what in spans]
                yield pd.DataFrame(list(dict.fromkeys(out)), columns=["_key", "kind", "surface"])

    slim = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return slim.mapInPandas(run, f"_key {kind}, kind string, surface string").distinct().withColumnRenamed("_key", key)


def redact(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with [KIND] in the place of each span; spans that overlap an earlier one are left out."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def redacted(rows: DataFrame, key: str, text: str, data: bytes | None = None) -> DataFrame:
    """(key, redacted): each row's text with typed placeholders, otherwise unchanged; null stays null."""
    trained = data or weights()

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        reader, out = _reader(trained), []
        texts = series.tolist()
        for at in range(0, len(texts), TEXTS):
            part = texts[at : at + TEXTS]
            out += [None if t is None else redact(t, s) for t, s in zip(part, reader.find(part))]
        return pd.Series(out, dtype=object)

    return rows.select(F.col(key), run(F.col(text)).alias("redacted"))
