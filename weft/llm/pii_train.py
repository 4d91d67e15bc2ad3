"""Training of the personal-data network from labelled spans, in numpy.

    python -m weft.llm.pii_train DOCUMENTS.parquet [MINUTES [OUTPUT]]

Labelled spans come from two sources, half and half. Labelling functions mark spans in the documents:
phrases that announce a kind, with the shapes of what follows; half of these examples are copied with
other digits and letters. And pii_phrases makes sentences in five languages from carriers and values
made by rule, with look-alikes that are no personal data. Both only make the examples; nothing of
them is used when texts are read. A tenth of the documents and a seventh of the carriers are held
out to measure what was learned.
"""

from __future__ import annotations

import io
import multiprocessing
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd

from weft.llm import pii_phrases
from weft.llm.pii import FIRST_INSIDE, KINDS, TAGS, WEIGHTS, WINDOW, Network, Reader, load, stretches

EMBED, HIDDEN, RATE = 16, 20, 0.008

_U = r"[A-ZÀ-ÖØ-Þ]"
_WORD = rf"(?:{_U}['’]?[\w'’]+(?:-{_U}?[\w'’]+)*)"
_ANY = r"(?:[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*)"
_NAME = rf"(?:{_WORD}, {_WORD}(?: {_U}\.)?|{_U}\.(?: ?{_U}\.)* {_WORD}|{_WORD}(?: {_U}\.)+ {_WORD}|{_WORD} {_WORD})"
_FREE = rf"(?:{_ANY}|{_U}\.)(?:,? (?:{_ANY}|{_U}\.)){{1,3}}"
_HANNAME = r"[㐀-鿿]{2,4}"
_AT, _DOT = r"(?: ?(?:@|\[at\]|\(at\)) ?| at )", r"(?:\.| ?(?:\[dot\]|\(dot\)) ?| dot )"
_MAIL = rf"[A-Za-z0-9_.+%-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{1,3}}"
_NUM = r"[+(]?\d[\d ().\-/]*\d"
_TOWN = rf"{_WORD}(?:-{_WORD})*"

#: (kind, pattern): group 1 is the labelled span.
FUNCTIONS: list[tuple[str, re.Pattern[str]]] = [
    *(("email", re.compile(p, re.I)) for p in (
        r"(?<![A-Za-z0-9_.+@-])([A-Za-z0-9_.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9]))",
        rf"(?:Write to|Replies went to|Contact ?:|Kontakt:|Contacto:|cc|bitte an|Escriba a|Écrire à|联系|邮箱:) ?<?({_MAIL})")),
    *(("phone", re.compile(p)) for p in (
        rf"(?:Call|Phone|answers on|tel:|T[ée]l\.|Telefonisch unter|Joignable au|Llame al|电话|致电) ?({_NUM})",)),
    *(("ssn", re.compile(p)) for p in (rf"(?:SSN(?: is)?\)?|social security number:) ?({_NUM})",)),
    *(("id_number", re.compile(p)) for p in (
        r"(?:National ID|identity card|Passport no\.|Ausweisnummer|Documento de identidad|Pièce d['’]identité n°|身份证号) ?([A-Z]{2}\d{7}|[A-Z]{2}(?: \d\d){3} [A-Z]|\d{17}[\dX]|\d{8}-[A-Z]|\d\d(?: \d+)+|(?=[A-Z]*\d)[A-Z0-9]{8,12})",)),
    *(("credit_card", re.compile(p)) for p in (rf"(?:card number|Paid with card|Bezahlt mit Karte|Payé par carte|Pagado con la tarjeta|付款卡号) ?({_NUM})",)),
    *(("ipv4", re.compile(p)) for p in (r"(?:Client|came from|Anmeldung von|connexion depuis|acceso vino de|登录来自) ?(\d{1,3}(?:\.\d{1,3}){3})",)),
    *(("address", re.compile(p)) for p in (
        rf"(?:papers to|moved to|Visiting address:) ((?:Flat \w+, )?\d+[a-z]? {_WORD} [A-Z]\w+\.?(?:, Apt \w+)?, {_TOWN}(?: (?:[A-Z]\d \d[A-Z]{{2}}|\d{{5}}))?|P\.?O\.? Box \d+, {_TOWN}(?: (?:[A-Z]\d \d[A-Z]{{2}}|\d{{5}}))?)",
        rf"(?:Post bitte an|Anschrift lautet) ({_WORD}(?:str\.)?(?: {_WORD})? \d+[a-z]?, \d{{5}} {_TOWN})",
        rf"(?:dossier au|Adresse :) (\d+(?: bis| ter)?,? [a-zé]+ (?:des?|du|de la|d['’])? ?{_WORD}, \d{{5}} {_TOWN})",
        rf"(?:papeles a|Dirección:) ((?:C/|Calle|Avenida|Paseo|Plaza) {_WORD} \d+(?:, \d+\.º [A-Z])?, \d{{5}} {_TOWN})",
        r"(?:寄到|地址:) ?([㐀-鿿]+\d+号(?:\d+栋)?(?:\d+室)?)")),
    *(("name", re.compile(p)) for p in (
        rf"Ask (?:Dr\. |Prof\. |Mr\. |Mrs\. |Ms\. )?({_FREE}) about the old", rf"Thanks to ({_FREE}) for the", rf"According to ({_FREE}), nothing", rf"approved by ({_NAME})(?=[.<*_,]|$)", rf"approved by ({_FREE})\.",
        rf"(?:^|[.] |: |>)({_FREE}) wrote the fir", rf"Signed, ({_NAME})", rf"Signed, ({_FREE})$", rf"Frau (?:Dr\. )?({_FREE}) hat den", rf"Herr (?:Dr\. )?({_FREE}) hat den", rf"Geprüft von ({_FREE})\.", rf"Mme (?:Dr\. )?({_FREE}) a corrig", rf"Relu par ({_FREE})\.",
        rf"señora? (?:Dra?\. )?({_FREE}) corrig", rf"Revisado por ({_FREE})\.", rf"本页由({_FREE}|{_HANNAME}?)审核", rf"(?:^|。 ?)({_FREE}|{_HANNAME}?)老师修改")),
]


def label(text: str) -> list[tuple[int, int, str]]:
    """The labelled spans of a stretch; of overlapping ones the first function's counts."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern in FUNCTIONS:
        for m in pattern.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in " ,":
                b -= 1
            if not any(a < y and x < b for x, y, _ in out):
                out.append((a, b, kind))
    return sorted(out)


def varied(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A copy with other digits, other letters in names and addresses of mail, and names typed in other ways."""
    out, moved, at = [], [], 0
    digits = lambda s: "".join(rng.choice("0123456789") if c.isdigit() else c for c in s)
    swap = {**dict.fromkeys("aeiou", "aeiou"), **dict.fromkeys("bcdfghjklmnpqrstvwxz", "bcdfghjklmnpqrstvwxz")}
    for a, b, kind in spans:
        out.append(digits(text[at:a]))
        body = text[a:b]
        if kind == "name":
            body = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.35 else c for c in body)
            if " " in body and rng.random() < 0.2:
                first, _, last = body.rpartition(" ")
                body = f"{first} {rng.choice(['de', 'van', 'von', 'da', 'del'])} {last}" if "," not in body else body
            body = rng.choice([body, body, body, body, body, body.upper(), body.lower()])
        elif kind == "email":
            body = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.25 and i < len(body) // 2 else c for i, c in enumerate(body))
        elif kind != "ipv4":
            body = digits(body)
        start = sum(map(len, out))
        out.append(body)
        moved.append((start, start + len(body), kind))
        at = b
    return "".join(out) + digits(text[at:]), moved


def adam(params: dict[str, np.ndarray], rate: float):
    m, v, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0

    def update(grads: dict[str, np.ndarray], scale: float) -> None:
        nonlocal step
        step += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] -= (scale * rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    return update


def transitions(p: dict[str, np.ndarray]) -> np.ndarray:
    """The table of steps from tag to tag that the four kinds of weights stand for; steps that can't be are -inf."""
    n, one = len(TAGS), FIRST_INSIDE
    table = np.full((n, n), -np.inf)
    table[:, :one] = p["leave"][:, None] + p["enter"]
    k = np.arange(len(KINDS))
    table[1 + k, one + k], table[one + k, one + k] = p["begun"], p["inside"]
    return table


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood per text of padded texts (time, text), and its gradients."""
    t_max, n = ids.shape
    hidden, one = p["u0"].shape[0], FIRST_INSIDE
    mask = (np.arange(t_max)[:, None] < lengths).astype(np.float32)
    x = p["embed"][ids]
    kept = []
    total = np.zeros((t_max, n, len(TAGS)), np.float32) + p["bias"]
    for way in (0, 1):
        h, c = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
        pre = x @ p[f"w{way}"] + p[f"b{way}"]
        steps = []
        hs = np.zeros((t_max, n, hidden), x.dtype)
        for t in range(t_max) if way == 0 else range(t_max - 1, -1, -1):
            z = pre[t] + h @ p[f"u{way}"]
            gate = np.clip(0.25 * z[:, : 2 * hidden] + 0.5, 0, 1)
            i, o, g = gate[:, :hidden], gate[:, hidden:], np.tanh(z[:, 2 * hidden :])
            new = c + i * (g - c)
            th = np.tanh(new)
            live = mask[t][:, None]
            steps.append((t, h, c, gate, g, th, live))
            h = live * (o * th) + (1 - live) * h
            c = live * new + (1 - live) * c
            hs[t] = h
        total = total + hs @ p["out"][way * hidden : (way + 1) * hidden]
        kept.append((steps, hs))
    # CRF: forward and backward in logarithms
    e = total.astype(np.float64)
    table = transitions(p)
    big = np.exp(table)
    alpha, beta = np.zeros(e.shape), np.zeros(e.shape)
    alpha[0] = e[0] + np.r_[p["enter"], np.full(len(KINDS), -1e9)]
    for t in range(1, t_max):
        top = alpha[t - 1].max(1, keepdims=True)
        step = np.log(np.exp(alpha[t - 1] - top) @ big + 1e-300) + top + e[t]
        alpha[t] = np.where(mask[t][:, None] > 0, step, alpha[t - 1])
    log_z = np.logaddexp.reduce(alpha[-1], axis=1)
    d_table = np.zeros_like(big)
    for t in range(t_max - 2, -1, -1):
        ahead = e[t + 1] + beta[t + 1]
        top = ahead.max(1, keepdims=True)
        scaled = np.exp(ahead - top)
        back = np.log(scaled @ big.T + 1e-300) + top
        live = mask[t + 1][:, None] > 0
        left = np.exp(alpha[t] - log_z[:, None] + top) * live
        d_table += (left.T @ scaled) * big
        beta[t] = np.where(live, back, beta[t + 1])
    d_e = np.exp(alpha + beta - log_z[:, None]) * mask[:, :, None]
    rows = np.arange(n)
    d_first = d_e[0].sum(0)[:one]
    score = p["enter"][gold[0]] + sum((e[t, rows, gold[t]] * mask[t]) for t in range(t_max))
    np.add.at(d_first, gold[0], -1.0)
    for t in range(t_max):
        d_e[t, rows, gold[t]] -= mask[t]
        if t:
            score = score + np.where(mask[t] > 0, table[gold[t - 1], gold[t]], 0.0)
            np.add.at(d_table, (gold[t - 1], gold[t]), -mask[t])
    k = np.arange(len(KINDS))
    grads = {key: np.zeros_like(value) for key, value in p.items()}
    d = (d_e / n).astype(x.dtype)
    grads["leave"], grads["enter"] = d_table[:, :one].sum(1) / n, (d_table[:, :one].sum(0) + d_first) / n
    grads["begun"], grads["inside"] = d_table[1 + k, one + k] / n, d_table[one + k, one + k] / n
    grads["bias"] = d.sum((0, 1))
    d_x = np.zeros_like(x)
    for way, (steps, hs) in enumerate(kept):
        part = slice(way * hidden, (way + 1) * hidden)
        grads["out"][part] = np.tensordot(hs, d, ((0, 1), (0, 1)))
        from_out = d @ p["out"][part].T
        dh, dc = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
        for t, h, c, gate, g, th, live in reversed(steps):
            i, o = gate[:, :hidden], gate[:, hidden:]
            dh = dh + from_out[t]
            dho, dco = dh * live, dc * live
            cell = dco + dho * o * (1 - th * th)
            straight = (gate > 0) & (gate < 1)
            dz = np.concatenate([np.concatenate([cell * (g - c), dho * th], axis=1) * straight * 0.25, cell * i * (1 - g * g)], axis=1).astype(x.dtype)
            grads[f"u{way}"] += h.T @ dz
            grads[f"w{way}"] += x[t].T @ dz
            grads[f"b{way}"] += dz.sum(0)
            d_x[t] += dz @ p[f"w{way}"].T
            dh = dz @ p[f"u{way}"].T + dh * (1 - live)
            dc = cell * (1 - i) + dc * (1 - live)
    np.add.at(grads["embed"], ids, d_x)
    return float((log_z - score).mean()), grads


def examples(texts: list[str], rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Different stretches with their labelled spans: all with spans or digits, and a part of the quiet ones."""
    seen: dict[str, list[tuple[int, int, str]]] = {}
    for text in texts:
        for _, s in stretches(text):
            if s not in seen:
                seen[s] = label(s)
    out = []
    for s, spans in seen.items():
        if len(s) > 400:
            continue
        loud = spans or re.search(r"\d{3}|@", s)
        if loud or rng.random() < 0.2:
            out.append((s, spans))
            for _ in range(2 if any(k == "name" for _, _, k in spans) else int(bool(loud)) * (rng.random() < 0.6)):
                out.append(varied(s, spans, rng))
    return out


def score(network: Network, held: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of labelled spans by kind."""
    reader = Reader(network)
    hit, said, there = Counter(), Counter(), Counter()
    for at in range(0, len(held), 4096):
        part = held[at : at + 4096]
        reader.seen = {}
        reader.read(list(dict.fromkeys(s for s, _ in part)))
        for s, spans in part:
            got, want = set(reader.seen[s]), set(spans)
            said.update(k for *_, k in got)
            there.update(k for *_, k in want)
            hit.update(k for *_, k in got & want)
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, there[k]), there[k]) for k in KINDS}


def told(marks: dict[str, tuple[float, float, int]]) -> str:
    return ", ".join(f"{k} {a:.3f}/{b:.3f} of {c}" for k, (a, b, c) in marks.items())


def batched(data: list[tuple[str, list[tuple[int, int, str]]]], coder: Network, numbers: np.random.Generator, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded places, tags and lengths of stretches of similar length."""
    coded = []
    for s, spans in data:
        tags = np.zeros(len(s), dtype=np.int64)
        for a, b, k in spans:
            tags[a:b] = FIRST_INSIDE + KINDS.index(k)
            tags[a] = 1 + KINDS.index(k)
        for at in range(0, len(s), WINDOW):
            part = tags[at : at + WINDOW].copy()
            if part[0] >= FIRST_INSIDE:  # a window begins inside a span
                part[0] -= len(KINDS)
            coded.append((coder.encode([s[at : at + WINDOW]]), part))
    coded.sort(key=lambda x: len(x[0]))
    out = []
    for at in range(0, len(coded), size):
        batch = coded[at : at + size]
        lengths = np.array([len(x) for x, _ in batch])
        ids, gold = np.zeros((lengths.max(), len(batch)), np.int64), np.zeros((lengths.max(), len(batch)), np.int64)
        for j, (x, y) in enumerate(batch):
            ids[: len(x), j], gold[: len(y), j] = x, y
        out.append((ids, gold, lengths))
    numbers.shuffle(out)
    return out


_SHARED: dict[str, object] = {}


def _begin(texts: list[str], neutral: list[str], chars: dict[str, int], seed: int) -> None:
    number = int(re.sub(r"\D", "", multiprocessing.current_process().name) or 0)
    _SHARED.update(rng=random.Random(seed + number), numbers=np.random.default_rng(seed + number), texts=texts, neutral=neutral, queue=[])
    _SHARED["coder"] = empty(chars, _SHARED["numbers"])


def _work(p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of this worker's next batch: half of labelled stretches, half of made sentences."""
    queue: list = _SHARED["queue"]  # type: ignore[assignment]
    if not queue:
        rng: random.Random = _SHARED["rng"]  # type: ignore[assignment]
        maker = pii_phrases.Maker(rng)
        made = [maker.sentence(_SHARED["neutral"]) for _ in range(4000)]  # type: ignore[arg-type]
        queue += batched([*rng.sample(_SHARED["texts"], 2000), *made], _SHARED["coder"], _SHARED["numbers"], 64)  # type: ignore[arg-type]
    return gradients(p, *queue.pop())


def empty(chars: dict[str, int], numbers: np.random.Generator) -> Network:
    normal = lambda *shape, by: (numbers.standard_normal(shape) * by).astype(np.float32)
    start = np.r_[np.full(HIDDEN, -2.0), np.zeros(2 * HIDDEN)].astype(np.float32)  # cells keep rather than take
    zeros = lambda n: np.zeros(n, np.float32)
    two = lambda *shape, by: [normal(*shape, by=by), normal(*shape, by=by)]
    return Network(chars, normal(len(chars) + 1, EMBED, by=0.3), two(EMBED, 3 * HIDDEN, by=0.25), two(HIDDEN, 3 * HIDDEN, by=0.18), [start.copy(), start.copy()], normal(2 * HIDDEN, len(TAGS), by=0.2), zeros(len(TAGS)), zeros(len(TAGS)), zeros(FIRST_INSIDE), zeros(len(KINDS)), zeros(len(KINDS)))


def train(texts: list[str], seconds: float, seed: int = 7, workers: int = 8, say=print) -> bytes:
    """Weights after this many seconds, each step averaging the workers' gradients."""
    rng, numbers = random.Random(seed), np.random.default_rng(seed)
    held_texts, texts = texts[::10], [t for i, t in enumerate(texts) if i % 10]
    data = examples(texts, rng)
    neutral = [s for s, spans in data if not spans and len(s) < 200]
    known = Counter(c for s, _ in data for c in s)
    maker = pii_phrases.Maker(rng)
    known.update(c for _ in range(5000) for c in maker.sentence(neutral)[0])
    chars = [chr(i) for i in range(32, 127)] + ["一", "ø", "§", "\t"]
    chars += sorted(c for c, k in known.items() if k >= 60 and c not in chars and c.isprintable())
    place = {c: i + 1 for i, c in enumerate(chars)}
    net = empty(place, numbers)
    p = {"embed": net.embed, "out": net.out, "bias": net.bias, "leave": net.leave, "enter": net.enter, "begun": net.begun, "inside": net.inside}
    for way in (0, 1):
        p |= {f"w{way}": net.w[way], f"u{way}": net.u[way], f"b{way}": net.b[way]}

    def pack() -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, chars=np.array([ord(c) for c in chars], dtype=np.int32), **{k: v.astype(np.float16) for k, v in p.items()})
        return out.getvalue()

    held = [(s, label(s)) for t in held_texts for _, s in dict.fromkeys(stretches(t))]
    other = pii_phrases.Maker(random.Random(seed + 1), held=True)
    phrases = [other.fill(*line) for group in other.lines.values() for line in group for _ in range(40)]
    say(f"{len(data)} labelled stretches, {len(neutral)} of them neutral, {len(chars)} known characters")
    update, began, step, loss = adam(p, RATE), time.time(), 0, 0.0
    with multiprocessing.get_context("fork").Pool(workers, _begin, (data, neutral, place, seed)) as pool:
        while (spent := (time.time() - began) / seconds) < 1:
            got = pool.map(_work, [p] * workers, chunksize=1)
            update({k: sum(g[k] for _, g in got) / workers for k in p}, 0.5 * (1 + np.cos(np.pi * spent)) + 0.01)
            loss += sum(x for x, _ in got) / workers
            step += 1
            if step % 1500 == 0:
                say(f"step {step}, {time.time() - began:.0f} s, loss {loss / 1500:.4f}; held-out carriers: {told(score(load(pack()), phrases))}")
                loss = 0.0
    done = load(pack())
    say(f"held-out documents: {told(score(done, held))}\nheld-out carriers: {told(score(done, phrases))}")
    return pack()


if __name__ == "__main__":
    frame = pd.read_parquet(sys.argv[1], columns=["text"])
    minutes = float(sys.argv[2]) if len(sys.argv) > 2 else 8.0
    target = Path(sys.argv[3]) if len(sys.argv) > 3 else Path(__file__).with_name(WEIGHTS)
    target.write_bytes(train([t for t in frame["text"] if isinstance(t, str)], 60 * minutes, say=lambda x: print(x, flush=True)))
