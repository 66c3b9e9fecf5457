"""Personal data: a linear-chain conditional random field over word shapes, beside fixed patterns.

The patterns (email, ip, card, phone) are the base; the field adds spans that
do not overlap a base span, such as phone numbers without a country sign. Words
that hold a digit or an at sign are active: their features are their shape,
length, digit groups, a checksum, and those of their neighbours. All other
words share one feature. The field is trained by gradient ascent on a small
labelled table (text, spans) and decoded by Viterbi in numpy batches of equal
length. When the trained weights prove that a word without active features is
outside in every best path, the chain falls apart at such words, and only the
active stretches need decoding; else whole texts are decoded.

Null text counts as empty. Offsets are code points, ends exclusive. Repeated
rows are kept, further columns ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talus.llm.text import by_slices, split_words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 1 << 11
PLAIN = 0
EPOCHS = 60
RATE = 0.1
DECAY = 1e-3

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
EDGES = " \t\n\v\f\r.,;:!?\"'<>[]{}|*#$%&="

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Checksum of card numbers: every second digit from the right counts twice, digit sums taken."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches without backtracking: each at sign takes the local characters before it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > free and text[low - 1] in LOCAL:
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            out.append(("email", low, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start."""
    out = _emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _size_band(n: int) -> int:
    return n if n < 5 else 5 + (n > 8) + (n > 12) + (n > 15) + (n > 19)


def _shape(word: str) -> str:
    out = []
    for c in word[:64]:
        kind = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:24])


def word_features(word: str) -> list[str]:
    """Of one active word, without its neighbours."""
    core = word.strip(EDGES)
    groups = re.findall(r"[0-9]+", core)
    digits = "".join(groups)
    local, at, domain = core.partition("@")
    return [
        f"shape {_shape(core)}",
        f"digits {_size_band(len(digits))}",
        "groups " + ".".join(str(min(len(g), 9)) for g in groups[:6]),
        f"letters {any(c.isalpha() for c in core)}",
        f"at {bool(at)} {bool(local)} {'.' in domain}",
        f"quad {len(groups) == 4 and core.count('.') == 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups)}",
        f"luhn {13 <= len(digits) <= 19 and len(digits) < 64 and luhn(digits)} {len(groups)}",
        f"opens {core[:1] if core[:1] in '+(' else ''}",
    ]


def _index(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode()) % (FEATURES - 1)


def sequence_features(words: list[str], active: list[bool]) -> list[list[int]]:
    """Feature numbers of each word; those of inactive words are [PLAIN]."""
    own = [word_features(w) if a else None for w, a in zip(words, active)]
    out = []
    for i, features in enumerate(own):
        if features is None:
            out.append([PLAIN])
            continue
        near = [own[j] if 0 <= j < len(own) else None for j in (i - 1, i + 1)]
        sides = [f"{side} {'plain' if f is None else f[0] + f[1]}" for side, f in zip(("before", "after"), near)]
        out.append([_index(f) for f in (*features, *sides)])
    return out


def is_active(word: str) -> bool:
    return any("0" <= c <= "9" or c == "@" for c in word)


@dataclass
class Field:
    unary: np.ndarray  # FEATURES x labels
    moves: np.ndarray  # labels x labels

    def plain_is_outside(self) -> bool:
        """Whether relabelling any inactive word as O always raises a path's score."""
        u, t = self.unary[PLAIN], self.moves
        worst = [
            u[0] - u[y] + (t[:, 0] - t[:, y]).min() + (t[0] - t[y]).min() for y in range(1, len(LABELS))
        ]
        return min(worst) > 0

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.unary[f].sum(axis=0) for f in features])


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of a batch (sequences x words x labels) that starts and ends outside."""
    best = scores[:, 0] + moves[0]
    back = np.zeros(scores.shape, np.int8)
    for i in range(1, scores.shape[1]):
        through = best[:, :, None] + moves
        back[:, i] = through.argmax(axis=1)
        best = through.max(axis=1) + scores[:, i]
    path = np.empty(scores.shape[:2], np.int8)
    path[:, -1] = (best + moves[:, 0]).argmax(axis=1)
    rows = np.arange(len(scores))
    for i in range(scores.shape[1] - 1, 0, -1):
        path[:, i - 1] = back[rows, i, path[:, i]]
    return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[tuple[str, list[Span]]]) -> Field:
    """Fit to (text, spans) rows by Adam on the penalised likelihood; small tables only."""
    # Sentences of one length band make a batch: the shorter ones are filled up with words outside.
    by_length: dict[int, tuple[list, list]] = {}
    for text, spans in rows:
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        if not words:
            continue
        labels = [0] * len(words)
        for kind, low, high in spans:
            inside = [i for i, (_, a, b) in enumerate(words) if a < high and b > low]
            for k, i in enumerate(inside):
                labels[i] = LABELS.index(("I-" if k else "B-") + kind)
        texts = [w for w, _, _ in words]
        band = -(-len(words) // 16) * 16
        x, y = by_length.setdefault(band, ([], []))
        x.append(sequence_features(texts, [is_active(w) for w in texts]) + [[PLAIN]] * (band - len(words)))
        y.append(labels + [0] * (band - len(words)))
    width = len(LABELS)
    parameters = [np.zeros((FEATURES, width)), np.zeros((width, width))]
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    batches = []
    for x, y in by_length.values():
        depth = max(len(f) for s in x for f in s)
        numbers = np.array([[f + [-1] * (depth - len(f)) for f in s] for s in x])
        batches.append((numbers, np.array(y)))
    for step in range(1, EPOCHS + 1):
        slopes = [-DECAY * p for p in parameters]
        unary, moves = parameters
        for numbers, y in batches:
            filled = (numbers >= 0)[..., None]
            scores = (unary[numbers] * filled).sum(axis=2)
            n = scores.shape[1]
            forward, backward = np.empty_like(scores), np.empty_like(scores)
            forward[:, 0] = scores[:, 0] + moves[0]
            for i in range(1, n):
                forward[:, i] = _log_sum(forward[:, i - 1, :, None] + moves, 1) + scores[:, i]
            backward[:, -1] = moves[:, 0]
            for i in range(n - 2, -1, -1):
                backward[:, i] = _log_sum(moves + (scores[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            total = _log_sum(forward[:, -1] + moves[:, 0], 1)
            chance = np.exp(forward + backward - total[:, None, None])
            error = np.eye(width)[y] - chance
            inside = filled[..., 0]
            for k in range(width):
                spread = np.broadcast_to(error[:, :, None, k], numbers.shape)[inside]
                slopes[0][:, k] += np.bincount(numbers[inside], spread, FEATURES)
            np.add.at(slopes[1], (0, slice(None)), error[:, 0].sum(axis=0))
            np.add.at(slopes[1], (slice(None), 0), error[:, -1].sum(axis=0))
            for i in range(1, n):
                pair = forward[:, i - 1, :, None] + moves + (scores[:, i] + backward[:, i])[:, None, :]
                np.add.at(slopes[1], (y[:, i - 1], y[:, i]), 1)
                slopes[1] -= np.exp(pair - total[:, None, None]).sum(axis=0)
        for k, slope in enumerate(slopes):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope**2
            parameters[k] = parameters[k] + RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Field(*parameters)


def labelled_rows(seed: int = 8, size: int = 400) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences drawn from a rule, half of their numbers personal."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    name = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))

    def card() -> str:
        body = pick("4", "5", "37", "6") + digits(int(rng.integers(12, 15)))
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        mark = pick("", " ", "-")
        return mark.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        area, mid, last = digits(3), digits(3), digits(4)
        return pick(f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"+1 ({area}) {mid}-{last}", f"+{digits(2)} {area} {mid} {last}", f"1-{area}-{mid}-{last}")

    def personal() -> tuple[str, str]:
        return pick(
            ("email", f"{name()}{pick('', '.' + digits(2), '_' + name())}@{name()}{pick('', digits(1))}.{pick('com', 'org', 'example.net')}"),
            ("ip", ".".join(str(v) for v in rng.integers(0, 256, 4))),
            ("card", card()),
            ("phone", phone()),
        )

    def other() -> str:
        broken = next(n for n in iter(lambda: digits(16), None) if not luhn(n))
        return pick(
            digits(4), digits(int(rng.integers(1, 7))), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
            f"{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f"{digits(2)}%", broken, f"{name()}{digits(2)}", f"@{name()}", f"{name()} @ {name()}",
            f"token = \"{digits(5)}{name()}{digits(6)}{name()}{digits(8)}\"", f"password={name()}{digits(7)}{name()}{digits(3)}", f"{digits(3)}.{digits(3)}.{digits(3)}.999",
            f"{digits(1)}/{digits(2)}/{digits(4)}", f"{digits(3)},{digits(3)}", f"#{digits(3)}", f"{digits(2)}***", f"{digits(10)}{digits(12)}", f"item_{digits(4)}", f"{digits(3)}-{digits(2)}",
        )

    rows = []
    for _ in range(size):
        text, spans = "", []
        for _ in range(int(rng.integers(2, 7))):
            text += " ".join(name() for _ in range(int(rng.integers(0, 4)))) + " "
            if rng.random() < 0.5:
                kind, value = personal()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += other()
            text += pick("", "", ".", ",") + pick(" ", " ", "\n") + name() + " "
        rows.append((text, spans))
    return rows


def _plausible(kind: str, value: str) -> bool:
    """An exact check of an added span: the digits or signs its kind can't be without."""
    digits = "".join(DIGITS.findall(value))
    if kind == "email":
        return "@" in value.strip("@")
    if kind == "ip":
        return len(re.findall("[0-9]+", value)) == 4 and all(int(g) <= 255 for g in re.findall("[0-9]{1,9}", value))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def added_spans(field: Field, texts: list[str], column: pa.Array) -> list[list[Span]]:
    """Spans of the field in each text."""
    words = split_words(column)
    marked = ((words.data >= 48) & (words.data <= 57)) | (words.data == 64)
    total = np.concatenate([[0], np.cumsum(marked)])
    active = total[words.end] > total[words.start]
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    # First byte of each document, in code points.
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    chosen = np.flatnonzero(active) if field.plain_is_outside() else np.arange(len(active))
    out: list[list[Span]] = [[] for _ in texts]
    if not len(chosen):
        return out
    doc = words.doc[chosen]
    low, high = points[words.start[chosen]] - base[doc], points[words.end[chosen]] - base[doc]
    new = np.ones(len(chosen), bool)
    new[1:] = (np.diff(chosen) != 1) | (doc[1:] != doc[:-1])
    begin = np.append(np.flatnonzero(new), len(chosen))
    stretches: dict[int, list[int]] = {}
    for a, b in zip(begin, begin[1:]):
        stretches.setdefault(int(b - a), []).append(int(a))
    for length, starts in stretches.items():
        scores = []
        for a in starts:
            own = [texts[doc[i]][low[i] : high[i]] for i in range(a, a + length)]
            scores.append(field.scores(sequence_features(own, [is_active(w) for w in own])))
        for a, path in zip(starts, viterbi(np.array(scores), field.moves)):
            i = 0
            while i < length:
                if path[i] == 0:
                    i += 1
                    continue
                kind = KINDS[(path[i] - 1) // 2]
                j = i + 1
                while j < length and path[j] == LABELS.index(f"I-{kind}"):
                    j += 1
                d = int(doc[a + i])
                x, y = int(low[a + i]), int(high[a + j - 1])
                value = texts[d][x:y]
                x += len(value) - len(value.lstrip(EDGES))
                y -= len(value) - len(value.rstrip(EDGES))
                if x < y and _plausible(kind, texts[d][x:y]):
                    out[d].append((kind, x, y))
                i = j
    return out


def all_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans and those added that overlap none of them, by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for kind, low, high in more:
        if all(b <= low or a >= high for a, b in taken):
            out.append((kind, low, high))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def printed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
_NONE = hashlib.sha256(b"").hexdigest()
_SIGNS = re.compile(r"[0-9@]")


def find(docs: DataFrame, rows: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_rows() if rows is None else rows))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) if _SIGNS.search(t) else [] for t in texts]
        more = added_spans(shared.value, texts, batch.column("text"))
        both = [all_spans(a, b) if b else a for a, b in zip(base, more)]
        columns = {"doc_id": batch.column("doc_id")}
        for k in KINDS:
            columns[f"n_{k}"] = pa.array([sum(s[0] == k for s in own) for own in base], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(printed(s).encode()).hexdigest() if s else _NONE for s in base], pa.string())
        columns["spans"] = pa.array([printed(s) for s in both], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(by_slices(one), SCHEMA)


def mask(docs: DataFrame, rows: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and n_chars counted anew if present.

    A null text stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_rows() if rows is None else rows))
    names = docs.columns
    # Columns go by their place while in Arrow, whatever their names hold.
    places = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, n_chars = f"c{names.index('text')}", f"c{names.index('n_chars')}" if "n_chars" in names else None

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = batch.column(text).to_pylist()
        texts = [t or "" for t in given]
        more = added_spans(shared.value, texts, batch.column(text))
        out = []
        for raw, value, extra in zip(given, texts, more):
            spans = all_spans(base_spans(value), extra) if _SIGNS.search(value) else []
            pieces, at = [], 0
            for kind, low, high in sorted(spans, key=lambda s: (s[1], -s[2])):
                if high <= at:
                    continue
                if low >= at:
                    pieces += [value[at:low], f"<{kind}>"]
                at = high
            out.append(raw if not spans else "".join([*pieces, value[at:]]))
        columns = dict(zip(batch.schema.names, batch.columns))
        columns[text] = pa.array(out, pa.string())
        if n_chars:
            columns[n_chars] = pa.array([None if t is None else len(t) for t in out], pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    return places.mapInArrow(by_slices(one, text), places.schema).toDF(*names)
