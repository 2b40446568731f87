"""Operator 11: secrets in texts, by patterns and a character convolutional network.

Three patterns give the base findings.  Every candidate, a run of 12 or more
characters that keys are made of, is also judged by a small convolutional
network over its characters and those around it; runs longer than a window are
judged piece by piece, the whole run by its best piece.  The network learns from
labelled findings (the base findings where none are given): all candidates,
each in its own surroundings and in those of others, so that a secret without a
telling name before it is known by itself.  Candidates are dealt to learners of
some thousands by a hash; each fits the network to its own, and after every round
the weights of all learners are averaged.  Out-of-fold scores of all candidates
calibrate it (Platt) and give, for each shape of candidate, the highest
threshold at which the wanted share of labelled findings is found.  Unlabelled
candidates that pass it unseen are left out when the last network is fitted.

A text is read once, in one task.  Its candidates go on as windows of character
codes, a fixed number of bytes for each piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.llm.staging import dropped, staged

# The base patterns, in the order of their kinds, and the least lengths of their matches.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII | re.IGNORECASE), 2, 6),
    # Their least lengths stand in the patterns: what a failing match would take holds no other match.
    ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
]
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]  # one of them is in every text with an assignment
KINDS = [k for k, *_ in BASE]
ADDED = "network"                # kind of the spans that the network adds

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")
BEFORE, PIECE, AFTER = 24, 40, 8  # characters of a window
WINDOW = BEFORE + PIECE + AFTER
CODES = 98                        # 0 outside, 1-95 printable ASCII, 96 other, 97 line ends and tabs
SHAPES = [re.compile(r"[0-9a-f]+"), re.compile(r"[A-Z0-9]+")]  # and all others

ROWS = 20_000      # candidates of a learner, about
BATCH = (12, 12, 40)  # labelled findings, others with digits and others without in a step
STEPS = 600        # steps of a learner at least, over its candidates as often as that takes
ROUNDS = 3         # after which the learners' weights are averaged
JUDGED = 10_000    # candidates whose windows are joined at once
LEAST = 20         # findings below which nothing is learnt
FOLDS = 3
WIDTH, CHANNELS, FILTERS = 5, 8, 24

_CODE = np.full(256, 96, dtype=np.uint8)
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 13]] = 97
_CODE_TABLE = _CODE.tobytes()


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """The matches of the patterns that are long enough, by start, then kind as listed."""
    low = text.lower()
    named = any(name in low for name in NAMES)
    found = [Span(kind, *m.span()) for kind, pattern, group, least in BASE if named or kind != "assign"
             for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def shape_of(run: str) -> int:
    return next((k for k, p in enumerate(SHAPES) if p.fullmatch(run)), len(SHAPES))


def windows_of(text: str) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(start, end, shape, holds a digit, windows of its pieces) of every candidate."""
    codes = None
    for m in CANDIDATE.finditer(text):
        if codes is None:
            codes = text.encode("latin-1", "replace").translate(_CODE_TABLE)
        start, end = m.span()
        pieces = []
        for s in range(start, end, PIECE):
            e = min(s + PIECE, end)
            pieces += [codes[max(0, s - BEFORE):s].rjust(BEFORE, b"\0"), codes[s:e].ljust(PIECE, b"\0"),
                       codes[e:e + AFTER].ljust(AFTER, b"\0")]
        yield start, end, shape_of(m.group()), DIGIT.search(text, start, end) is not None, b"".join(pieces)


SPANS = "array<struct<kind: string, start: int, end: int>>"
CANDIDATES = "array<struct<start: int, end: int, shape: int, digit: boolean, windows: binary>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_JUDGED = pa.list_(pa.struct([*_SPAN.value_type, pa.field("probability", pa.float64())]))
_CANDIDATE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("shape", pa.int32()),
                                 ("digit", pa.bool_()), ("windows", pa.binary())]))


def _lists(rows: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of structs from lists of tuples."""
    of = kind.value_type
    flat = list(zip(*(x for row in rows for x in row))) or [()] * of.num_fields
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, of)], fields=list(of)), type=kind)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), _lists([base_spans(t) for t in texts], _SPAN),
             _lists([list(windows_of(t)) for t in texts], _CANDIDATE)], names=["id", "base", "candidates"])


# ---- the network -------------------------------------------------------------------------

INSIDE = np.zeros(WINDOW, dtype=np.uint8)  # characters of the piece have codes of their own
INSIDE[BEFORE:BEFORE + PIECE] = CODES


class Network:
    """Embedded characters, one convolution, its largest and mean answers, a logistic output."""

    def __init__(self, seed: int = 0, weights: list[np.ndarray] | None = None):
        draw = np.random.default_rng(seed)
        deep = WIDTH * (CHANNELS + 1)
        self.weights = weights or [
            draw.normal(size=(CODES, CHANNELS)) * 0.3, draw.normal(size=(deep, FILTERS)) * np.sqrt(2 / deep),
            np.zeros(FILTERS), draw.normal(size=2 * FILTERS) * 0.2, np.zeros(1)]
        self.weights = [w.astype(np.float32) for w in self.weights]

    def _answers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters that each filter sees, channel by channel, a row for each place; its answers."""
        table, kernel, bias, _, _ = self.weights
        both = np.ones((2, CODES, CHANNELS + 1), dtype=table.dtype)
        both[:, :, :CHANNELS] = table
        both[0, :, CHANNELS] = 0
        x = both.reshape(2 * CODES, CHANNELS + 1).take(codes + INSIDE, axis=0)
        places = WINDOW - WIDTH + 1
        seen = np.empty((len(codes), places, CHANNELS + 1, WIDTH), dtype=table.dtype)
        for k in range(WIDTH):
            seen[..., k] = x[:, k:k + places]
        seen = seen.reshape(-1, (CHANNELS + 1) * WIDTH)
        answers = seen @ kernel
        answers += bias
        return seen, np.maximum(answers, 0, out=answers).reshape(len(codes), places, FILTERS)

    def _logits(self, top: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.full(answers.shape[1], 1 / answers.shape[1], dtype=answers.dtype) @ answers
        pooled = np.concatenate([top, mean], axis=1)
        return pooled, pooled @ self.weights[3] + self.weights[4][0]

    def scores(self, codes: np.ndarray, at_once: int = 64) -> np.ndarray:
        """Logits of the windows."""
        parts = []
        for k in range(0, len(codes), at_once):
            _, answers = self._answers(codes[k:k + at_once])
            parts.append(self._logits(answers.max(axis=1), answers)[1])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, by every weight."""
        kernel, out = self.weights[1], self.weights[3]
        seen, answers = self._answers(codes)
        places = answers.shape[1]
        top = answers.argmax(axis=1)
        rows, filters = np.arange(len(codes))[:, None], np.arange(FILTERS)
        most = answers[rows, top, filters]
        pooled, logits = self._logits(most, answers)
        error = ((1 / (1 + np.exp(-logits)) - labels) / len(labels)).astype(np.float32)
        spread = error[:, None] * out[None, :]
        back = (answers > 0) * (spread[:, None, FILTERS:] / places)
        back[rows, top, filters] += spread[:, :FILTERS] * (most > 0)
        flat = back.reshape(-1, FILTERS)
        deep = np.zeros((CHANNELS, *codes.shape), dtype=np.float32)
        by_place = kernel.reshape(CHANNELS + 1, WIDTH, FILTERS)[:CHANNELS].transpose(1, 0, 2).reshape(-1, FILTERS)
        for k, moved in enumerate((by_place @ flat.T).reshape(WIDTH, CHANNELS, -1, places)):
            deep[:, :, k:k + places] += moved
        at = codes.ravel()
        of_table = np.stack([np.bincount(at, d.ravel(), CODES) for d in deep], axis=1)
        return [of_table, seen.T @ flat, np.ones(len(flat), flat.dtype) @ flat, pooled.T @ error, np.array([error.sum()])]


def train(net: Network, codes: np.ndarray, kinds: np.ndarray, part: int, seed: list[int], rate: float = 0.003) -> None:
    """Fit ``net`` by Adam to a learner's candidates (kinds as in BATCH) for one of ROUNDS rounds.

    All rounds together take every candidate at least once; the same rows give the same network.
    """
    draw = np.random.default_rng([*seed, 0])
    groups = [draw.permutation(np.flatnonzero(kinds == k)) for k in range(len(BATCH))]
    steps = max([STEPS, *(-(-len(g) // n) for g, n in zip(groups, BATCH))])
    draw = np.random.default_rng([*seed, 1, part])
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    begin, end = steps * part // ROUNDS, steps * (part + 1) // ROUNDS
    for step in range(begin, end):
        some = np.concatenate([g[np.arange(step * n, (step + 1) * n) % len(g)] for g, n in zip(groups, BATCH) if len(g)])
        own = codes[some]
        # Two of three stand in the surroundings of others.
        moved = codes[draw.integers(len(codes), size=len(some))]
        moved[:, BEFORE:BEFORE + PIECE] = own[:, BEFORE:BEFORE + PIECE]
        seen = np.where((draw.random(len(some)) < 2 / 3)[:, None], moved, own)
        t = step - begin + 1
        for w, m, v, g in zip(net.weights, first, second, net.gradients(seen, (kinds[some] == 0).astype(np.float32))):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)


def elsewhere(codes: np.ndarray, seed: int) -> np.ndarray:
    """The candidates in the surroundings of others."""
    other = codes[np.random.default_rng(seed).permutation(len(codes))]
    other[:, BEFORE:BEFORE + PIECE] = codes[:, BEFORE:BEFORE + PIECE]
    return other


def calibration(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's (slope, shift), by Newton steps on his smoothed targets."""
    return _newton(lambda *at: _platt(logits, labels, *at), labels.sum(), (1 - labels).sum())


def _platt(logits: np.ndarray, labels: np.ndarray, w: list[float], up: float, down: float) -> np.ndarray:
    """Hessian and gradient (two by three) of the loss at ``w``, summed over the rows."""
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(x @ np.array(w), -30, 30)))
    return x.T @ np.concatenate([x * (p * (1 - p))[:, None], (p - np.where(labels > 0, up, down))[:, None]], axis=1)


def _newton(sums, positives: float, negatives: float) -> tuple[float, float]:
    up, down = float((positives + 1) / (positives + 2)), float(1 / (negatives + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        s = sums(w.tolist(), up, down)
        step = np.linalg.solve(s[:, :2] + 1e-6 * np.eye(2), s[:, 2])
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def probability(logits: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * logits.astype(np.float64) + shift, -30, 30)))


def thresholds(p: np.ndarray, labels: np.ndarray, shapes: np.ndarray, recall: float) -> list[float]:
    """Per shape, the highest threshold that finds ``recall`` of its labelled findings (of all, where it has few)."""
    found = []
    for shape in range(len(SHAPES) + 1):
        own = p[(labels > 0) & (shapes == shape)]
        own = np.sort(own if len(own) >= LEAST else p[labels > 0])
        found.append(float(own[int(np.floor((1 - recall) * len(own)))]))
    return found


class Judge(NamedTuple):
    weights: list[np.ndarray]
    slope: float
    shift: float
    limits: list[float]


# ---- fits over all candidates ----------------------------------------------------------------
# A learner's candidates are one row: slot, n, and packed codes, kinds, folds and shapes.

SLOT = "slot long, n long, codes binary, kinds binary, folds binary, shapes binary"


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["place", "windows"])
    kinds = np.where(frame["found"], 0, np.where(frame["digit"], 1, 2)).astype(np.uint8)
    return pd.DataFrame({"slot": frame["slot"].iloc[:1], "n": len(frame), "codes": b"".join(frame["windows"]), "kinds": kinds.tobytes(),
                         "folds": (frame["place"].to_numpy() % FOLDS).astype(np.uint8).tobytes(),
                         "shapes": frame["shape"].to_numpy().astype(np.uint8).tobytes()})


def _unpacked(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple]:
    """(slot, codes, kinds, folds, shapes) of every learner, and its ``extra`` scores."""
    for batch in batches:
        for row in range(batch.num_rows):
            r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            yield (r["slot"], np.frombuffer(r["codes"], np.uint8).reshape(-1, WINDOW).copy(),
                   *(np.frombuffer(r[c], np.uint8) for c in ("kinds", "folds", "shapes")),
                   *(np.frombuffer(r[c], np.float32) for c in extra))


def _fit(slots: DataFrame, without: list[int], keep=None) -> dict[int, Network]:
    """Per fold of ``without``: a network fitted to the candidates of the others (for which ``keep`` holds).

    A task returns one weighted sum of its learners' weights a network.
    """
    nets = {k: Network() for k in without}
    extra = ["own"] if keep else []
    for part in range(ROUNDS):
        held = {k: [w.copy() for w in net.weights] for k, net in nets.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: (0, [np.zeros(w.shape) for w in ws]) for k, ws in held.items()}
            for slot, codes, kinds, folds, shapes, *own in _unpacked(batches, *extra):
                for k, ws in held.items():
                    used = folds != k
                    if keep:
                        used &= keep(kinds, shapes, own[0])
                    if used.any():
                        net = Network(weights=[w.copy() for w in ws])
                        train(net, codes[used], kinds[used], part, [slot, k])
                        n = int(used.sum())
                        sums[k] = sums[k][0] + n, [a + n * w for a, w in zip(sums[k][1], net.weights)]
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array(list(sums), pa.int64()), "n": pa.array([n for n, _ in sums.values()], pa.int64()),
                "weights": pa.array([[w.tobytes() for w in ws] for _, ws in sums.values()], pa.list_(pa.binary()))})

        got = slots.mapInArrow(run, "fold long, n long, weights array<binary>").collect()
        for k in without:
            own = [r for r in got if r["fold"] == k and r["n"]]
            total = sum(r["n"] for r in own)
            if total:
                nets[k] = Network(weights=[sum(np.frombuffer(r["weights"][i]) for r in own).reshape(w.shape) / total
                                           for i, w in enumerate(held[k])])
    return nets


def _scored(slots: DataFrame, nets: dict[int, Network]) -> DataFrame:
    """The learners' rows with the scores of networks that have not seen them: ``own``, and ``moved`` elsewhere."""
    weights = {k: net.weights for k, net in nets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_nets = {k: Network(weights=[w.copy() for w in ws]) for k, ws in weights.items()}
        for batch in batches:
            columns = [[], []]
            for slot, codes, _, folds, _ in _unpacked([batch]):
                scores = np.zeros((2, len(codes)), dtype=np.float32)
                for k, net in own_nets.items():
                    held = folds == k
                    scores[0, held] = net.scores(codes[held])
                    scores[1, held] = net.scores(elsewhere(codes[held], slot))
                for c, x in zip(columns, scores):
                    c.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in columns)],
                                             names=[*batch.schema.names, "own", "moved"])

    return slots.mapInArrow(run, SLOT + ", own binary, moved binary")


def _summed(scored: DataFrame, of) -> np.ndarray:
    """Sum of the arrays that ``of(kinds, shapes, own, moved)`` gives for all learners; a task returns one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, _, kinds, _, shapes, own, moved in _unpacked(batches, "own", "moved"):
            total = total + of(kinds, shapes, own, moved)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    shape = of(*(np.zeros(0, t) for t in (np.uint8, np.uint8, np.float32, np.float32))).shape
    return sum(np.array(r["sums"]) for r in scored.mapInArrow(run, "sums array<double>").collect()).reshape(shape)


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats."""
    bits = (x + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _limits(scored: DataFrame, slope: float, shift: float, recall: float) -> list[float]:
    """``thresholds`` of all candidates' scores: the wanted ranks, found byte by byte from counts."""
    few = len(SHAPES) + 1            # labelled findings by shape, then all
    sign = np.float32(1 if slope >= 0 else -1)

    def counts(kinds, shapes, own, moved, known=None, byte=0):
        bits = _ordered_bits(np.concatenate([own, moved]) * sign)
        shapes, found = np.concatenate([shapes] * 2), np.concatenate([kinds] * 2) == 0
        out = []
        for s in range(few + 1):
            mine = found & ((shapes == s) | (s == few))
            if byte:
                mine &= bits >> np.uint32(32 - 8 * byte) == known[s]
            out.append(np.bincount(bits[mine] >> np.uint32(24 - 8 * byte) & np.uint32(255), minlength=256))
        return np.array(out)

    known, ranks = [0] * (few + 1), None
    for byte in range(4):
        of = _summed(scored, lambda *x, known=tuple(known), byte=byte: counts(*x, known=known, byte=byte))
        if ranks is None:
            ranks = [int(np.floor((1 - recall) * n)) for n in of.sum(axis=1)]
            sizes = of.sum(axis=1)
        for s in range(few + 1):
            at = int(np.searchsorted(np.cumsum(of[s]), ranks[s], side="right"))
            ranks[s] -= int(of[s][:at].sum())
            known[s] = known[s] << 8 | min(at, 255)
    bits = np.array(known, dtype=np.uint32)
    logits = np.where(bits >> 31, bits ^ np.uint32(1 << 31), ~bits).astype(np.uint32).view(np.float32) * sign
    p = probability(logits, slope, shift)
    return [float(p[s] if sizes[s] >= LEAST else p[few]) for s in range(few)]


def learn(candidates: DataFrame, recall: float) -> Judge | None:
    """The judge that all ``candidates`` (id, start, shape, digit, windows, found) give.

    Learners, networks, scores, calibration and thresholds take every candidate;
    sums and weights reach the driver, of a fixed size for each task.
    """
    n, found = candidates.agg(F.count(F.lit(1)), F.count(F.when(F.col("found"), 1))).first()
    if found < LEAST or found == n:
        return None
    # The first piece of a long run stands for it.
    rows = candidates.select("shape", "found", "digit", F.substring("windows", 1, WINDOW).alias("windows"),
                             F.shiftrightunsigned(F.xxhash64("id", "start"), 1).alias("place"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("place", "windows"), F.lit(-(-n // ROWS))))
    slots = staged(rows.groupBy("slot").applyInPandas(_pack, SLOT), "learners")
    scored = staged(_scored(slots, _fit(slots, list(range(FOLDS)))), "scores")
    counted = _summed(scored, lambda kinds, *_: np.array([(kinds == 0).sum(), (kinds > 0).sum()]) * 2)
    slope, shift = _newton(lambda *at: _summed(scored, lambda kinds, shapes, own, moved: _platt(
        np.concatenate([own, moved]), np.concatenate([kinds == 0] * 2), *at)), *counted)
    limits = _limits(scored, slope, shift, recall)

    # Rows without a label that networks which have not seen them find are no examples of what is no secret.
    def certain(kinds: np.ndarray, shapes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (kinds == 0) | (probability(own, slope, shift) < np.array(limits)[shapes])

    last = _fit(scored, [FOLDS], certain)[FOLDS]
    dropped(slots, scored)
    return Judge(last.weights, slope, shift, limits)


def _judge(judge: Judge | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = judge and Network(weights=[w.copy() for w in judge.weights])
        for batch in batches:
            bases, lists = (batch.column(c) for c in ("base", "candidates"))
            added = [[] for _ in range(batch.num_rows)]
            of, parts = pc.list_parent_indices(lists).to_pylist(), lists.flatten()
            if net is not None and of:
                windows = parts.field("windows").to_pylist()
                pieces = np.cumsum([0, *(len(w) // WINDOW for w in windows)])
                logits = np.concatenate([net.scores(np.frombuffer(b"".join(windows[k:k + JUDGED]), np.uint8).reshape(-1, WINDOW))
                                         for k in range(0, len(windows), JUDGED)])
                p = probability(np.maximum.reduceat(logits, pieces[:-1]), judge.slope, judge.shift)
                starts, ends = (parts.field(c).to_numpy() for c in ("start", "end"))
                for k in np.flatnonzero(p >= np.array(judge.limits)[parts.field("shape").to_numpy()]).tolist():
                    added[of[k]].append((int(starts[k]), len(KINDS), int(ends[k]), float(p[k])))
            spans = []
            for base, more in zip(bases.to_pylist(), added):
                found = [(x["start"], KINDS.index(x["kind"]), x["end"], 1.0) for x in base]
                found += [x for x in more if all(x[2] <= s or e <= x[0] for s, _, e, _ in found)]
                spans.append([([*KINDS, ADDED][k], s, e, p) for s, k, e, p in sorted(found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), bases, _lists(spans, _JUDGED)], names=["id", "base", "spans"])
    return run


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
         recall: float = 0.95) -> DataFrame:
    """The secrets of every text.

    Returns (id_col, base, spans), one row per row of ``docs``: ``base`` the spans
    (kind, start, end) of the patterns, ``spans`` these and those that the network
    adds, with a calibrated probability (1.0 for base spans), by start, then kind.
    Places count code points, ends are exclusive.  ``labelled`` (id_col, start,
    end) names findings to learn from, the base findings by default; with fewer than 20 of
    them among the candidates, or with nothing else, the network adds none.
    ``recall`` is the share of labelled findings, in their own and in other
    surroundings, that the thresholds must find.  Null and empty texts have no spans.  Rows that repeat an id
    are scanned on their own.  Other columns play no part; an empty table gives an empty table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _read, f"id {id_type}, base {SPANS}, candidates {CANDIDATES}")
    read = staged(read, "candidates")
    if labelled is None:
        known = read.withColumn("known", F.expr("transform(base, s -> struct(s.start AS start, s.end AS end))"))
    else:
        named = labelled.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("known"))
        known = read.join(named, "id", "left").withColumn("known", F.coalesce("known", F.expr(
            "CAST(array() AS array<struct<start: int, end: int>>)")))
    candidates = known.select("id", "known", F.explode("candidates").alias("c")).select(
        "id", "c.start", "c.shape", "c.digit", "c.windows",
        F.expr("exists(known, s -> s.start < c.end AND c.start < s.end)").alias("found"))
    judge = learn(candidates, recall)
    return read.mapInArrow(
        _judge(judge), f"id {id_type}, base {SPANS}, "
                       "spans array<struct<kind: string, start: int, end: int, probability: double>>"
    ).withColumnRenamed("id", id_col)
