"""A character-level bidirectional LSTM with CRF transitions, in numpy: model, training and a generator of labelled text.

Its gates are x / (1 + |x|), halved and shifted where they weigh, in place of tanh and sigmoid. They need no exponential,
which would take most of the time, and numpy computes them alike on every processor.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WIDTH, HIDDEN, SYMBOLS = 12, 16, 100
#: Characters of a training window; of a decoding window, and from one window's start to the next one's in a longer text.
LENGTH, WINDOW, STRIDE = 96, 2048, 1952
#: Symbols of padding read after a window that is not full, as in training.
PAD = 16
#: Windows read at once, and of those that may hold a span decoded at once; they bound a worker's memory.
BATCH, DECODED = 512, 32
#: Windows whose spans a model remembers, by their digest; some 20 MB.
REMEMBERED = 100_000
#: Steps whose symbols, or whose gains, are made ready at once.
AHEAD = 16
#: Score of O past a window's end.
SURELY = 100.0
#: The symbol of each code point up to 160, and at 161 of all beyond.
_SYMBOL = np.array([1] * 32 + [*range(1, 96)] + [98] * 34 + [97], np.int16)
_PARTS = ("embed", "fw", "fb", "bw", "bb", "out", "bias", "move", "first")


def symbols(text: str) -> np.ndarray:
    """Printable ASCII keeps its own number; other letters share one, white space is a space, the rest share one."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(x, 161)]


def start_weights(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    g = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
    forget = np.zeros(4 * HIDDEN, np.float32)
    forget[HIDDEN : 2 * HIDDEN] = 1
    move = np.zeros((TAGS, TAGS), np.float32)
    return {"embed": g(SYMBOLS, WIDTH) * 3, "fw": g(WIDTH + HIDDEN, 4 * HIDDEN), "fb": forget.copy(), "bw": g(WIDTH + HIDDEN, 4 * HIDDEN), "bb": forget.copy(), "out": g(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": move, "first": np.zeros(TAGS, np.float32)}


def allowed() -> np.ndarray:
    """Penalty of each move: an inside tag follows only its own begin or inside."""
    bad = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = -1e4
        bad[1 + 2 * k, 2 + 2 * k] = bad[2 + 2 * k, 2 + 2 * k] = 0
    return bad


BAD = allowed()
BAD_FIRST = np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, -1e4, 0), 0).astype(np.float32)


def _lstms(p: dict[str, np.ndarray], x: np.ndarray):
    """Hidden states (T, 2, B, H) of x (T, B, E) read forwards and backwards, and what the gradients need."""
    w, b = np.stack([p["fw"], p["bw"]]), np.stack([p["fb"], p["bb"]])[:, None]
    both = np.stack([x, x[::-1]], axis=1)
    n, _, batch, _ = both.shape
    gates = both @ w[:, :WIDTH] + b
    states, cells, shown = (np.zeros((n + 1, 2, batch, HIDDEN), x.dtype) for _ in range(3))
    inner = np.ascontiguousarray(w[:, WIDTH:])
    for t in range(n):
        z = gates[t]
        z += states[t] @ inner
        z /= 1 + np.abs(z)
        s = z[..., : 3 * HIDDEN]
        s += 1
        s *= 0.5
        c = z[..., HIDDEN : 2 * HIDDEN] * cells[t] + z[..., :HIDDEN] * z[..., 3 * HIDDEN :]
        cells[t + 1], shown[t + 1] = c, c / (1 + np.abs(c))
        states[t + 1] = z[..., 2 * HIDDEN : 3 * HIDDEN] * shown[t + 1]
    return states, (both, w, gates, cells, shown)


def _lstms_back(d: np.ndarray, states: np.ndarray, kept: tuple):
    """Gradients of x and of both directions' weights for the gradient d (T, 2, B, H) of the hidden states."""
    both, w, gates, cells, shown = kept
    n = len(both)
    # The slope of y = x / (1 + |x|) is (1 - |y|)^2.
    slope = lambda y: (1 - np.abs(y)) ** 2
    i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    out = o * slope(shown[1:])
    of_i, of_f, of_o = (slope(2 * y - 1) / 2 for y in (i, f, o))
    factor = np.concatenate([g * of_i, cells[:-1] * of_f, shown[1:] * of_o, i * slope(g)], axis=-1)
    dz = np.empty_like(gates)
    back = np.ascontiguousarray(w[:, WIDTH:].transpose(0, 2, 1))
    dh, dc = np.zeros_like(d[0]), np.zeros_like(d[0])
    for t in range(n - 1, -1, -1):
        dh += d[t]
        dc += dh * out[t]
        z = dz[t]
        z[...] = np.concatenate([dc, dc, dh, dc], axis=-1)
        z *= factor[t]
        dh, dc = z @ back, dc * f[t]
    flat = lambda v: v.transpose(1, 0, 2, 3).reshape(2, -1, v.shape[-1])
    zs = flat(dz)
    dw = np.concatenate([flat(both).transpose(0, 2, 1) @ zs, flat(states[:-1]).transpose(0, 2, 1) @ zs], axis=1)
    dx = dz @ w[:, :WIDTH].transpose(0, 2, 1)
    return dx[:, 0] + dx[::-1, 1], dw, zs.sum(axis=1)


def _emit(p: dict[str, np.ndarray], ids: np.ndarray):
    """ids (T, B) to tag scores (T, B, K)."""
    x = p["embed"][ids]
    states, kept = _lstms(p, x)
    both = np.concatenate([states[1:, 0], states[1:, 1][::-1]], axis=2)
    return both @ p["out"] + p["bias"], (x, states, kept, both)


def _marginals(e: np.ndarray, move: np.ndarray, first: np.ndarray):
    """Scaled forward and backward sums, whose product is each tag's posterior, the emissions' exponentials over their
    step's scale, and the log partition."""
    n = len(e)
    top = e.max(axis=2, keepdims=True)
    x, m = np.exp(e - top), np.exp(move)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty_like(top)
    for t in range(n):
        a = x[t] * (alpha[t - 1] @ m if t else np.exp(first))
        np.add.reduce(a, axis=1, keepdims=True, out=scale[t])
        np.divide(a, scale[t], out=alpha[t])
    x /= scale
    for t in range(n - 2, -1, -1):
        np.matmul(beta[t + 1] * x[t + 1], m.T, out=beta[t])
    return alpha, beta, x, (top + np.log(scale))[..., 0].sum(axis=0)


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of tags (T, B) and its gradients."""
    e, (x, states, kept, both) = _emit(p, ids)
    move, first = p["move"] + BAD, p["first"] + BAD_FIRST
    alpha, beta, scaled, z = _marginals(e, move, first)
    batch = ids.shape[1]
    gold = np.eye(TAGS, dtype=e.dtype)[tags]
    de = (alpha * beta - gold) / batch
    score = (e * gold).sum() + first[tags[0]].sum() + move[tags[:-1], tags[1:]].sum()
    dmove = np.exp(move) * np.tensordot(alpha[:-1], beta[1:] * scaled[1:], ([0, 1], [0, 1]))
    np.subtract.at(dmove, (tags[:-1], tags[1:]), 1)
    d = de @ p["out"].T
    dx, dw, db = _lstms_back(np.stack([d[..., :HIDDEN], d[::-1, :, HIDDEN:]], axis=1), states, kept)
    one = np.zeros((SYMBOLS, ids.size), e.dtype)
    one[ids.ravel(), np.arange(ids.size)] = 1
    return float((z.sum() - score) / batch), {"embed": one @ dx.reshape(-1, WIDTH), "fw": dw[0], "fb": db[0], "bw": dw[1], "bb": db[1], "out": np.tensordot(both, de, ([0, 1], [0, 1])), "bias": de.sum(axis=(0, 1)), "move": dmove / batch, "first": de[0].sum(axis=0)}


class Tagger:
    """Decoding with given weights, laid out for speed: what the symbols add to the gates is a table, a product a step adds
    what the states do, and all gates are computed in one go.

    Windows lie by falling length, and each is read to its own end only: at a step the windows that reach it are the first
    ones, and `reach` has their number. So what is found in a window depends on no other one. Each gate of the first windows
    is one piece of memory, however many they are.
    """

    def __init__(self, p: dict[str, np.ndarray]):
        by_gate = lambda w: np.ascontiguousarray(w.reshape(-1, 4, HIDDEN).transpose(1, 0, 2), np.float32)
        # Twice the hidden state is kept, so the weights it meets are halved.
        self.gates = [(by_gate(p[w][WIDTH:] / 2), by_gate(p["embed"] @ p[w][:WIDTH] + p[b])) for w, b in (("fw", "fb"), ("bw", "bb"))]
        self.out = [np.ascontiguousarray(p["out"][:HIDDEN].T / 2), np.ascontiguousarray(p["out"][HIDDEN:].T / 2)]
        self.bias, self.move, self.first = p["bias"], p["move"] + BAD, p["first"] + BAD_FIRST
        self.memory: dict[bytes, list[tuple[float, int, int, int]]] = {}

    def emissions(self, ids: np.ndarray, reach: np.ndarray | None = None, room: np.ndarray | None = None) -> np.ndarray:
        """ids (T, B) to tag scores (T, K, B), in room if given; where a window does not reach, the scores leave no tag but O."""
        n, batch = ids.shape
        e = (np.empty(n * TAGS * batch, np.float32) if room is None else room[: n * TAGS * batch]).reshape(n, TAGS, batch)
        runs = _runs(np.full(n, batch) if reach is None else reach)
        bias, work = self.bias[:, None], np.empty((2, 4 * batch * HIDDEN), np.float32)
        for (weights, table), out, parts, step in zip(self.gates, self.out, (runs, runs[::-1]), (1, -1)):
            state, cell, scores = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32), np.empty(TAGS * batch, np.float32)
            for a, b, k in parts:
                h, c, y = state[:k], cell[:k], scores[: TAGS * k].reshape(TAGS, k)
                z, x = work[:, : 4 * k * HIDDEN].reshape(2, 4, k, HIDDEN)
                i, f, o, g = z
                sigmoids, turned = z[:3], h.T
                for t, read in _ahead(ids, a, b, k, step):
                    np.take(table, read, axis=1, out=x, mode="clip")
                    np.matmul(h, weights, out=z)
                    z += x
                    _squash(z, x)
                    sigmoids += 1
                    c *= f
                    i *= g
                    c += i
                    c *= 0.5
                    h[...] = c
                    _squash(h, g)
                    h *= o
                    np.dot(out, turned, out=y)
                    np.add(e[t, :, :k] if step < 0 else bias, y, out=e[t, :, :k])
        for a, b, k in runs:
            e[a:b, :, k:] = 0
            e[a:b, 0, k:] = SURELY
        return e

    def may_tag(self, e: np.ndarray, reach: np.ndarray | None = None) -> np.ndarray:
        """Whether some path may beat the one without any span: exact, as it only overrates what spans gain.

        Viterbi in gains over the path without any span, from emissions (T, K, B), each with the move out of its span; only the
        move from one span right into another is overrated, by the best of these, and a span's end at the window's.
        """
        none, move = self.move[0, 0], self.move
        begin, within = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        col = lambda x: x.astype(np.float32)[:, None]
        out = col(move[1:, 0] - none)
        out_b, out_i = out[0::2], out[1::2]
        enter, deep = col(move[0, begin] - none) + out_b, col(move[within, within] - none)
        on = col(move[begin, within] - none) - out_b + out_i - deep
        again = col((move[1:, 1::2] - move[1:, :1]).max(axis=0)) + out_b - enter
        # What each step of a begin or inside tag costs at least goes with its gain.
        cost = np.stack([enter, deep], axis=1).reshape(-1, 1)
        size = e.shape[2]
        every = e[0, 1:] - e[0, 0] + out
        every[0::2] += (self.first[begin] - self.first[0])[:, None]
        every[1::2] = -1e4
        every_free, room = np.zeros(size, np.float32), np.empty((len(KINDS), size), np.float32)
        for a, z, k in _runs(np.full(len(e), size) if reach is None else reach):
            s, free, x = every[:, :k], every_free[:k], room[:, :k]
            b, i = s[0::2], s[1::2]
            for at in range(max(1, a), z, AHEAD):
                some = e[at : min(z, at + AHEAD), :, :k]
                gains = some[:, 1:] - some[:, :1]
                gains += cost
                for gain in gains:
                    end = np.maximum.reduce(s, axis=0)
                    np.add(b, on, out=x)
                    np.maximum(i, x, out=i)
                    np.add(end, again, out=x)
                    np.maximum(free, x, out=b)
                    s += gain
                    np.maximum(free, end, out=free)
        return (every_free > 0) | (np.maximum(every, every - out).max(axis=0) > 0)

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (T, B) by Viterbi and the posterior of each, from emissions."""
        n, batch, _ = e.shape
        rows, move = np.ascontiguousarray(e.transpose(0, 2, 1)), self.move[:, :, None]
        best, s = np.empty_like(rows), np.empty((TAGS, TAGS, batch), e.dtype)
        best[0] = rows[0] + self.first[:, None]
        for t in range(1, n):
            np.add(best[t - 1][:, None], move, out=s)
            np.maximum.reduce(s, axis=0, out=best[t])
            best[t] += rows[t]
        tags = np.empty((n, batch), np.int64)
        tags[-1] = best[-1].argmax(axis=0)
        for t in range(n - 1, 0, -1):
            (best[t - 1] + self.move.take(tags[t], axis=1)).argmax(axis=0, out=tags[t - 1])
        del rows, best
        alpha, beta, _, _ = _marginals(e, self.move, self.first)
        return tags, np.take_along_axis(alpha * beta, tags[:, :, None], 2)[:, :, 0]

    def spans(self, texts: list[str]) -> list[list[tuple[float, int, int, int, int, int]]]:
        """For each text (posterior, kind, start, end, window's start, window's end) of the spans of each window.

        Every text is covered whole by windows; the last one ends with the text. Windows of like length go together. What is
        found in a window depends on its own text alone, so equal windows are read once, and remembered for later calls.
        """
        found: list[list[tuple[float, int, int, int, int, int]]] = [[] for _ in texts]
        places: dict[bytes, list[tuple[int, int, int]]] = {}
        for d, x in enumerate(texts):
            for s in starts(len(x)):
                part = x[s : s + WINDOW]
                key = hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                places.setdefault(key, []).append((d, s, len(part)))
        if len(self.memory) + len(places) > REMEMBERED:
            self.memory.clear()
        new = {key: [] for key in places if key not in self.memory}
        self._tag(texts, sorted(((places[key][0][2], *places[key][0][:2], key) for key in new), reverse=True), new)
        for key, own in places.items():
            spans = new[key] if key in new else self.memory[key]
            for d, s, n in own if spans else ():
                found[d] += [(sure, k, s + a, s + b, s, s + n) for sure, k, a, b in spans]
        if len(new) <= REMEMBERED:
            self.memory.update(new)
        return found

    def _tag(self, texts: list[str], queue: list[tuple[int, int, int, bytes]], found: dict[bytes, list]) -> None:
        """Add the spans (posterior, kind, start, end) of windows (length, text, start, key), the longest first, to found."""
        if not queue:
            return
        known, waiting = {}, []
        # The first windows are the longest, so what they take serves the others too.
        room = np.empty(min(WINDOW, queue[0][0] + PAD) * TAGS * min(BATCH, len(queue)), np.float32)
        for at in range(0, len(queue), BATCH):
            part = queue[at : at + BATCH]
            sizes = np.array([min(WINDOW, n + PAD) for n, *_ in part])
            ids = np.zeros((len(part), sizes[0]), np.int16)
            for i, (n, d, s, _) in enumerate(part):
                if d not in known:
                    known[d] = symbols(texts[d])
                ids[i, :n] = known[d][s : s + n]
            # sizes fall, so as many windows reach step t as have a size over t.
            reach = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            e = self.emissions(np.ascontiguousarray(ids.T), reach, room)
            for j in np.flatnonzero(self.may_tag(e, reach)):
                waiting.append((part[j], e[: sizes[j], :, j].copy()))
                if len(waiting) == DECODED:
                    self._read(waiting, found)
                    waiting = []
        # Else they would stay beside what decoding takes.
        del room, ids, e
        self._read(waiting, found)

    def _read(self, windows: list[tuple[tuple[int, int, int, bytes], np.ndarray]], found: dict[bytes, list]) -> None:
        """Decode windows ((length, text, start, key), emissions (T, K)), the longest first, and add their spans to found."""
        if not windows:
            return
        e = np.zeros((len(windows[0][1]), len(windows), TAGS), np.float32)
        e[..., 0] = SURELY
        for j, (_, own) in enumerate(windows):
            e[: len(own), j] = own
        tags, sure = self.decode(e)
        for j in np.flatnonzero((tags > 0).any(axis=0)):
            n, _, _, key = windows[j][0]
            col, p, t = tags[:n, j], sure[:n, j], 0
            while t < n:
                if not col[t]:
                    t += 1
                    continue
                end = t + 1
                while end < n and col[end] == col[t] + 1:
                    end += 1
                found[key].append((float(p[t:end].min()), (int(col[t]) - 1) // 2, t, end))
                t = end


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place."""
    np.abs(x, out=room)
    room += 1
    x /= room


def _ahead(ids: np.ndarray, a: int, b: int, k: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """The steps from a to b, in the order of reading, and the symbols of the first k windows there, fit for np.take."""
    steps = range(a, b)[::step]
    for at in range(0, len(steps), AHEAD):
        some = steps[at : at + AHEAD]
        first = min(some)
        read = ids[first : first + len(some), :k].astype(np.intp)
        for t in some:
            yield t, read[t - first]


def _runs(reach: np.ndarray) -> list[tuple[int, int, int]]:
    """(first step, step after the last, windows) of the runs of steps that as many windows reach."""
    edges = [0, *(np.flatnonzero(np.diff(reach)) + 1).tolist(), len(reach)]
    return [(a, b, int(reach[a])) for a, b in zip(edges, edges[1:])]


def starts(length: int) -> list[int]:
    """Where the windows of a text of so many characters start."""
    return [] if not length else [*range(0, max(1, length - WINDOW + STRIDE), STRIDE)]


_SYLLABLES = "a e i o u th re st nd er in ch é ß ñ l m ou an ion ent ver la qu dor sch ung ado ción ê ly ing at ea ha en be it keit pf zu ü ö ä tz au ich ge ei ar dad ía ra mente os es eau ai oi aux elle ç pa tion oo ck sh wh ti ne to ri ka".split()
_SMALL = "the and of to in is at on for with dot or le la et de des und der die das el los que por a I by from call mail tel phone fax card ip host server write".split()
_ENDS = "com org net de fr es io edu info co.uk com.mx gov".split()
_ATS = ["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " at ", " AT ", " (AT) ", "(@)", " [@] ", "<at>"]
_DOTS = [".", ".", " . ", "(dot)", " (dot) ", "[dot]", " [dot] ", "{dot}", " dot ", " DOT ", " (DOT) ", "[.]", "(.)", "<dot>"]
_BARE_WORD = {" at ": (" dot ", "."), " AT ": (" DOT ", " dot ")}


def _word(rng: random.Random) -> str:
    r = rng.random()
    if r < 0.3:
        w = rng.choice(_SMALL)
    elif r < 0.85:
        w = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 6)))
    else:
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzeeaaiounrst") for _ in range(rng.randrange(1, 11)))
    r = rng.random()
    return w.capitalize() if r < 0.15 else w.upper() if r < 0.17 else w


def _prose(rng: random.Random, words: int) -> str:
    """Words with the marks of sentences; some of it all in capitals or with a mark after each word."""
    mark, out = rng.choice([" "] * 12 + ["!! ", " | ", ", ", ". "]), []
    for _ in range(words):
        out.append(_word(rng) + rng.choice([mark] * 8 + [". ", ", ", ".\n", "? "]))
    s = "".join(out).strip()
    return s.upper() if rng.random() < 0.05 else s


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randrange(10**n)).zfill(n) if n else ""


def _letters(rng: random.Random, low: int, high: int) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if rng.random() < 0.5 else rng.choice(["an", "er", "ma", "li", "jo", "sa", "to", "ne", "ri", "ka"]) for _ in range(rng.randrange(low, high)))


def _email(rng: random.Random) -> str:
    local = _letters(rng, 1, 7)
    if rng.random() < 0.6:
        local += rng.choice([".", ".", "_", "-", "+", ""]) + (_letters(rng, 1, 7) if rng.random() < 0.7 else _digits(rng, rng.randrange(1, 5)))
    host = _letters(rng, 1, 7) + (rng.choice(["-", ".", ""]) + _letters(rng, 1, 5) if rng.random() < 0.3 else "") + (_digits(rng, rng.randrange(1, 3)) if rng.random() < 0.2 else "")
    at = rng.choice(_ATS)
    dot = rng.choice(_BARE_WORD.get(at, _DOTS if at not in ("@", " @ ") or rng.random() < 0.4 else (".",)))
    # Where a dot is spelt out all of the host's are; in the local part some are.
    end = dot.join([*host.split("."), *rng.choice(_ENDS).split(".")])
    if rng.random() < 0.3:
        local = local.replace(".", dot)
    s = local + at + end
    r = rng.random()
    return s.upper() if r < 0.08 else s.title() if r < 0.14 else s


def _address(rng: random.Random) -> str:
    if rng.random() < 0.25:
        groups = [f"{rng.randrange(65536):x}" for _ in range(rng.randrange(3, 9))]
        return ":".join(groups) if len(groups) == 8 else "::".join([":".join(groups[:-1]), groups[-1]])
    dot = rng.choice([".", ".", ".", "[.]", "(.)", " . ", "[dot]", "(dot)", " dot ", " (dot) ", "{dot}"])
    return dot.join(str(rng.randrange(256)) for _ in range(4))


def _card(rng: random.Random) -> str:
    n = rng.choice([16, 16, 16, 16, 15, 14, 13, 19])
    s = [rng.randrange(10) for _ in range(n - 1)]
    s[0] = rng.choice([3, 4, 4, 5, 5, 6])
    odd = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(reversed(s)))
    text = "".join(map(str, s)) + str(-odd % 10)
    sep = rng.choice(["", " ", " ", "-", ".", "  ", "/", "_", " - ", "–"])
    cuts = (4, 10, 15) if n == 15 else range(4, n + 4, 4)
    return sep.join(text[a:b] for a, b in zip((0, *cuts), cuts) if text[a:b])


#: How phone numbers are written; # is a digit.
_PHONES = [
    "+1 (###) ###-####", "(###) ###-####", "(###)###-####", "###-###-####", "###.###.####", "### ### ####", "(###) ### ####", "1-###-###-####", "1 (###) ###-####", "+## ### ######", "+## (0)## #######",
    "+## ## ### ####", "+##-##-###-####", "+##.##.###.####", "00## ### ### ####", "00##-##-#######", "0##/#######", "0### ######", "0##-########", "0# ## ## ## ##", "0#.##.##.##.##", "(##) #### ####", "(##) ####-####",
    "+# ### ### ####", "+#-###-###-####", "+## #### ####", "+###########", "0### ### ###", "+## # ## ## ## ##",
]
#: Text that is none of the kinds; # is a digit, ~ a hexadecimal one, ^ a capital, _ a word.
_OTHERS = [
    "Version #.#.", "v#.##.#", "19##", "20##", "20##-1#-2#", "##.##.20##", "1/2#/19##", "20##-0#-1#T1#:##:##Z", "password=~~~~~~~~~~~~~~~~~~", 'token = "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"', "AKIA^#^^#^^^##^^^^^#", "~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~",
    "~~~~~~~~-~~~~-4~~~-~~~~-~~~~~~~~~~~~", "sk-~~~~~~~~~~~~~~~~~~~~", "##.##", "#,###.##", "$##,###", "#.###,## €", "#", "##", "###", "####", "#####", "######", "#######", "########", "########################", "# ###", "1#:##", "[#]", "[##]", "(#)", "(##)", "##%", "1#-2#", "# x #", "ISBN 978-#-##-######-#",
    "#. _", "@_", "_ @ # pm", "at #", "the dot at _", "_ at the _ dot", "dot", "at", "(at)", "[dot]", "http://www._.com/_?x=##", "https://_.org/##/_", "_.txt", "_.py", "_.com", "_.de", "x# = ##;", "f(_)[#]", "|", "---", "***", "Copyright (c) 20##", "<_>", "{}", "#.#", "#.#.#", "#####-####", "No. ####", "_##", "_-_", "_._", "_/_",
]


def _filled(rng: random.Random, form: str) -> str:
    fill = {"#": lambda: rng.choice("0123456789"), "~": lambda: rng.choice("0123456789abcdef"), "^": lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "_": lambda: _word(rng)}
    return "".join(fill[c]() if c in fill else c for c in form)


def _phone(rng: random.Random) -> str:
    return _filled(rng, rng.choice(_PHONES))


def _other(rng: random.Random) -> str:
    return _filled(rng, rng.choice(_OTHERS))


_ENTITY = {"email": _email, "ip": _address, "card": _card, "phone": _phone}


def labelled_text(rng: random.Random, length: int, share: float = 0.22) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """Made-up text of at least so many characters, a tag for each, and the spans (kind, start, end)."""
    text, tags, spans, plain = "", [], [], rng.random() < 0.35
    while len(text) < length:
        r = rng.random()
        if r < share and not plain:
            k = rng.randrange(len(KINDS))
            s = _ENTITY[KINDS[k]](rng)
            spans.append((k, len(text), len(text) + len(s)))
            tags += [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
        else:
            s = _other(rng) if r < share + 0.25 and not (plain and r > 0.1) else _prose(rng, rng.randrange(1, 12 if plain else 5))
            tags += [0] * len(s)
        text += s
        gap = rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", "; ", " (", ") ", ": ", " | ", "\n\n"])
        text += gap
        tags += [0] * len(gap)
    return text, tags, spans


def labelled(rng: random.Random, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of one window of made-up text with labelled spans; a quarter are short texts, padded as in decoding."""
    ids, gold = np.zeros(length, np.int64), np.zeros(length, np.int64)
    if rng.random() < 0.25:
        text, tags, _ = labelled_text(rng, rng.randrange(5, length), 0.5)
        text, tags = text.rstrip()[:length], tags[:length]
        ids[: len(text)], gold[: len(text)] = symbols(text), tags[: len(text)]
        return ids, gold
    text, tags, _ = labelled_text(rng, 2 * length)
    at = rng.randrange(len(text) - length)
    ids[:], gold[:] = symbols(text)[at : at + length], tags[at : at + length]
    # A window may open inside a span: its first tag is then a begin.
    if gold[0] and gold[0] % 2 == 0:
        gold[0] -= 1
    return ids, gold


@lru_cache(maxsize=2)
def trained(steps: int = 1100, batch: int = 32, seed: int = 7, rate: float = 0.05) -> dict[str, np.ndarray]:
    """Weights after so many steps of Adam on fresh labelled windows; the same for the same parameters."""
    rng = random.Random(seed)
    p = start_weights(seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        made = [labelled(rng) for _ in range(batch)]
        _, g = gradients(p, np.stack([x for x, _ in made]).T, np.stack([y for _, y in made]).T)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, step / 50, 1.05 - step / steps)
        for k in _PARTS:
            v = g[k] * min(1.0, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.98 * m2[k] + 0.02 * v * v
            p[k] = (p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return p
