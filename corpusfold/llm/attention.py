"""A small causal self-attention language model in numpy: training, and scoring in overlapping windows.

The model reads subword ids and predicts the class of the next one; the id within its class follows its
count in the training corpus. One attention block with a feed-forward layer, Adam, and exact gradients.

Training goes in rounds. In a round everyone who holds texts starts from the same parameters and takes
Adam's steps over its own; the changes are averaged, each row of the embeddings by how often its id was
read. Who holds which texts is up to the caller.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np


#: Windows that are computed together; what they need stays in a core's cache.
CHUNK = 56
#: Products with this many multiplications at most are done without copying their factors into another order first.
SMALL = 1_000_000
#: Scores are kept in units whose exponentials numpy takes fastest: of base 2 where it has vector code for them.
BASE2 = "AVX512" in str(np.lib.introspect.opt_func_info(func_name="^exp2$", signature="float32"))
exponential, UNIT = (np.exp2, float(np.log2(np.e))) if BASE2 else (np.exp, 1.0)


@dataclass(frozen=True)
class ModelOptions:
    width: int = 16
    hidden: int = 32
    window: int = 32
    overlap: int = 8  #: ids of a window that only serve as context for the others
    single: int = 64  #: most frequent ids, each a class of its own
    clusters: int = 64
    near: int = 256  #: most frequent ids, whose places beside an id say to which cluster it belongs
    rounds: int = 8
    steps: int = 400  #: a corpus with fewer batches than this is read more than once
    batch: int = 256
    rate: float = 3e-3


def start(vocabulary: int, o: ModelOptions, rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, classes = o.width, o.single + o.clusters
    shapes = {
        "embed": (vocabulary, d), "place": (o.window, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d),
        "w1": (d, o.hidden), "b1": (o.hidden,), "w2": (o.hidden, d), "b2": (d,), "out": (d, classes), "bias": (classes,),
    }
    return {
        n: (rng.normal(0, 1 / np.sqrt(s[0] if n not in ("embed", "place") else d), s) if len(s) > 1 else np.zeros(s)).astype(np.float32)
        for n, s in shapes.items()
    }


def forward(p: dict[str, np.ndarray], ids: np.ndarray) -> dict[str, np.ndarray]:
    """Hidden states of a batch of windows; a place attends to itself and what precedes it."""
    t = ids.shape[1]
    x = p["embed"][ids] + p["place"][:t]
    q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
    a = q @ k.transpose(0, 2, 1) / np.float32(np.sqrt(x.shape[2]))
    a += np.triu(np.full((t, t), -1e9, dtype=np.float32), 1)
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    m = a @ v
    h = x + m @ p["o"]
    f = np.maximum(h @ p["w1"] + p["b1"], 0)
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "m": m, "h": h, "f": f, "g": h + f @ p["w2"] + p["b2"]}


def fused(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Matrices that apply to columns of values, those for the same columns under each other, biases as a last column.

    The matrix of the queries holds that of the keys, too, so that the values themselves are the keys, and the matrix of
    what is mixed holds that of the output. ``back`` takes gradients the other way; class scores become rows.
    """
    kind, d = p["embed"].dtype.type, len(p["q"])
    pair, mixed = p["q"] @ p["k"].T * kind(1 / np.sqrt(d)), p["v"] @ p["o"]
    m = {"qv": np.concatenate([pair * kind(UNIT), mixed], axis=1)} | {
        name: np.concatenate([p[name], p[bias][None]]) for name, bias in (("w1", "b1"), ("w2", "b2"), ("out", "bias"))
    }
    m["out"] = (m["out"] * kind(UNIT)).T
    return {name: np.ascontiguousarray(v.T) for name, v in m.items()} | {
        "back": np.concatenate([pair, mixed], axis=1), "classes": np.ascontiguousarray(p["out"].T),
    }


def _summable(sums: np.ndarray) -> bool:
    """Whether powers with these sums were exact enough: else some scores are far from 0."""
    return not sums.size or bool(sums.min() > 1e-20 and sums.max() < 1e25)


def _over_ones(rows: int, columns: int, kind: np.dtype) -> np.ndarray:
    out = np.empty((rows + 1, columns), dtype=kind)
    out[rows] = 1
    return out


def _of_windows(values: np.ndarray, n: int) -> np.ndarray:
    """Columns of ``n`` windows, by window."""
    return values.reshape(len(values), n, -1).transpose(1, 0, 2)


@functools.lru_cache
def _seen(t: int, since: int, kind: np.dtype) -> np.ndarray:
    """1 where a target (column) sees a source (row)."""
    return np.ascontiguousarray(np.tri(t, dtype=kind).T[:, since:])


def states(p: dict[str, np.ndarray], m: dict[str, np.ndarray], ids: np.ndarray, since: int = 0) -> dict[str, np.ndarray]:
    """Hidden states of the places from ``since`` on, as ``forward`` gives them, a column for each place, with ``m`` of :func:`fused`.

    A last row of ones applies biases. Attention weights, by window, source and target, are not divided by their
    sums, which that row of the values gives in the same product. Powers may overflow on the way, which the caller is to allow.
    """
    (n, t), d = ids.shape, len(m["back"])
    size, kind = n * (t - since), m["back"].dtype
    x = p["embed"].take(ids.ravel(), 0)
    x.reshape(n, -1)[:] += p["place"][:t].ravel()
    x = np.ascontiguousarray(x.T)
    qv = _over_ones(2 * d, n * t, kind)
    np.matmul(m["qv"], x, out=qv[:-1])
    q, k, v = _of_windows(qv[:d], n)[:, :, since:], _of_windows(x, n), _of_windows(qv[d:], n)
    seen, mixed = _seen(t, since, kind), np.empty((d + 1, size), dtype=kind)
    for far in (False, True):
        a = k.transpose(0, 2, 1) @ q
        if far:
            a += np.where(seen == 0, kind.type(-1e9), 0)
            a -= a.max(axis=1, keepdims=True)
        exponential(a, out=a)
        a *= seen
        np.matmul(v, a, out=_of_windows(mixed, n))
        if _summable(mixed[-1]):
            break
    mean = mixed[:-1]
    mean /= mixed[-1]
    h = _over_ones(d, size, kind)
    np.add(mean.reshape(d, n, -1), x.reshape(d, n, t)[:, :, since:], out=h[:-1].reshape(d, n, -1))
    f = _over_ones(len(m["w1"]), size, kind)
    np.matmul(m["w1"], h, out=f[:-1])
    np.maximum(f, 0, out=f)
    g = _over_ones(d, size, kind)
    np.matmul(m["w2"], f, out=g[:-1])
    g[:-1] += h[:-1]
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "sum": mixed[-1], "m": mean, "h": h, "f": f, "g": g}


def _runs(size: int, other: int) -> list[slice]:
    """Cuts ``size`` places into runs whose products with matrices of ``other`` numbers are small."""
    most = max(32, SMALL // other // 32 * 32)
    step = -(-size // max(1, -(-size // most)) // 32) * 32 or 1  # whole vectors
    return [slice(at, at + step) for at in range(0, size, step)]


def _class_powers(m: dict[str, np.ndarray], g: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every column of ``g`` a row of powers of the class scores, their sum, the score of the class ``goal`` and its place among all.

    Powers may overflow on the way, which the caller is to allow.
    """
    z = np.empty((g.shape[1], m["out"].shape[1]), dtype=g.dtype)
    ones, at = np.ones(z.shape[1], dtype=g.dtype), np.arange(0, z.size, z.shape[1])
    at += goal
    for far in (False, True):
        for run in _runs(len(z), m["out"].size):
            np.matmul(g[:, run].T, m["out"], out=z[run])
        if far:
            z -= z.max(axis=1, keepdims=True)
        right = z.ravel().take(at)
        exponential(z, out=z)
        sums = z @ ones
        if _summable(sums):
            break
    return z, sums, right, at


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the classes ``target`` and its gradient; places with a negative target do not count."""
    loss, out, dx = _gradients(p, ids, target)
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, ids.ravel(), dx)
    return loss, out | {"embed": embed}


def _gradients(p: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray, measured: bool = True) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """The same, with the gradient of what was read at every place instead of that of the embeddings; a loss of 0 if it is not ``measured``."""
    m, total, out, dx = fused(p), max(1, int((target >= 0).sum())), {}, np.empty((ids.size, len(p["q"])), dtype=p["embed"].dtype)
    loss, t = 0.0, ids.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(ids), CHUNK):
            part, grads = _chunk_gradients(p, m, ids[i : i + CHUNK], target[i : i + CHUNK], total, dx[i * t : (i + CHUNK) * t], measured)
            loss += part
            for name, g in grads.items():
                out[name] = out[name] + g if name in out else g
    place = np.zeros_like(p["place"])
    place[:t] = (np.ones(len(ids), dtype=dx.dtype) @ dx.reshape(len(ids), -1)).reshape(t, -1)
    d = len(p["q"])
    pair, mixed = out["qv"][:, :d] * p["embed"].dtype.type(1 / np.sqrt(d)), out["qv"][:, d:]
    split = {"q": pair @ p["k"], "k": pair.T @ p["q"], "v": mixed @ p["o"].T, "o": p["v"].T @ mixed, "place": place}
    for name, bias in (("w1", "b1"), ("w2", "b2"), ("out", "bias")):
        split[name], split[bias] = out[name][:-1], out[name][-1]
    return loss, split, dx


def _chunk_gradients(
    p: dict[str, np.ndarray], m: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray, total: int, dx: np.ndarray, measured: bool
) -> tuple[float, dict[str, np.ndarray]]:
    """What some windows of a batch with ``total`` targets add to its loss and to the gradients of the matrices, biases as a last row.

    The gradient of what is read at every place is written to the rows of ``dx``.
    """
    s = states(p, m, ids)
    (n, t), d = ids.shape, len(m["back"])
    a, f, g, h, mean = s["a"], s["f"], s["g"], s["h"], s["m"]
    kind = g.dtype
    goal = target.ravel()
    counts = (goal >= 0).astype(kind)
    z, sums, right, here = _class_powers(m, g, np.maximum(goal, 0))
    loss = float((np.log(sums) - right * kind.type(1 / UNIT)) @ counts) / total if measured else 0.0
    z.ravel()[here] -= sums
    # what the rows are divided by is left to the narrower factors
    per = counts / (sums * kind.type(total))
    parts, weighted, dg = [], g * per, np.empty((d, n * t), dtype=kind)
    for run in _runs(len(z), m["out"].size):
        parts.append(weighted[:, run] @ z[run])
        np.multiply((z[run] @ m["classes"]).T, per[run], out=dg[:, run])
    out = {"out": sum(parts[1:], start=parts[0])}
    out["w2"] = f @ dg.T
    df = p["w2"] @ dg
    df *= f[:-1] > 0
    out["w1"] = h @ df.T
    dh = p["w1"] @ df
    dh += dg
    dm = np.empty((d + 1, n * t), dtype=kind)
    np.multiply(dh, 1 / s["sum"], out=dm[:-1])
    # the last row takes the mean of a place's gradients off in the same product
    np.matmul(-np.ones(d, dtype=kind), dm[:-1] * mean, out=dm[-1])
    dm = _of_windows(dm, n)
    ds = s["v"].transpose(0, 2, 1) @ dm
    ds *= a
    dqv = np.empty((2 * d, n * t), dtype=kind)
    np.matmul(s["k"], ds, out=_of_windows(dqv[:d], n))
    np.matmul(dm[:, :-1], a.transpose(0, 2, 1), out=_of_windows(dqv[d:], n))
    out["qv"] = s["x"] @ dqv.T
    dh += m["back"] @ dqv
    np.matmul(ds, (s["x"].T @ m["back"][:, :d]).reshape(n, t, d), out=dx.reshape(n, t, d))
    dx += dh.T
    return loss, out


# -- classes ----------------------------------------------------------------------------------------


def clustered(count: np.ndarray, o: ModelOptions) -> tuple[np.ndarray, np.ndarray]:
    """Place of every id among those that are clustered, -1 for others, and its rank by its count in the corpus."""
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(count), dtype=np.int64)
    rank[order] = np.arange(len(count))
    place = rank - o.single
    place[(count == 0) | (place < 0)] = -1
    return place, rank


def neighbours(texts: Iterable[np.ndarray], place: np.ndarray, rank: np.ndarray, end: int, o: ModelOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """How often frequent ids precede and follow the clustered ones: numbers ``place * 2 * near + side`` and counts.

    ``texts`` are sequences of whole texts, each closed with ``end``. Before a text stands an end, after it nothing.
    """
    size = (int(place.max()) + 1) * 2 * o.near
    # the number of a pair is a sum of what either side gives; below 0 where one of them does not count
    never = -max(1, size)
    mine, other = np.where(place >= 0, place * (2 * o.near), never), np.where(rank < o.near, rank, never)
    ahead = mine + o.near
    ahead[end] = never
    kind = np.int32 if size < 1 << 30 else np.int64
    mine, other, ahead = (v.astype(kind) for v in (mine, other, ahead))
    table = np.zeros(size, dtype=np.int32)
    read = 0
    for ids in texts:
        if not len(table) or not len(ids):
            continue
        if read + len(ids) >= 1 << 30:  # counts stay within 32 bits
            yield (seen := np.flatnonzero(table)), table[seen].astype(np.int64)
            table[:] = 0
            read = 0
        read += len(ids)
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20) + 1]
            follows = other[part]
            first = mine[part[:1]] + other[end] if at == 0 else part[:0]
            for pair in (first, mine[part[1:]] + follows[:-1], ahead[part[:-1]] + follows[1:]):
                np.add.at(table, pair[pair >= 0].astype(np.intp), np.int32(1))  # other types are added far slower
    yield (seen := np.flatnonzero(table)), table[seen].astype(np.int64)


def classes(count: np.ndarray, pairs: np.ndarray, times: np.ndarray, o: ModelOptions) -> np.ndarray:
    """A class for every id: frequent ids alone, others clustered by their ``neighbours``, unseen ones by their number."""
    place, rank = clustered(count, o)
    out = o.single + np.arange(len(count)) % o.clusters
    rest = np.flatnonzero(place >= 0)
    if len(rest) >= o.clusters:
        table = np.zeros((len(rest), 2 * o.near), dtype=np.float32)
        table.reshape(-1)[pairs] = times
        np.sqrt(table, out=table)
        table /= np.sqrt(np.einsum("ij,ij->i", table, table))[:, None] + np.float32(1e-6)
        centre = table[np.random.default_rng(0).choice(len(rest), o.clusters, replace=False)]
        for _ in range(8):
            mine = np.argmax(table @ centre.T, axis=1)
            for c in range(o.clusters):
                if (mine == c).any():
                    mean = table[mine == c].mean(axis=0)
                    centre[c] = mean / (np.linalg.norm(mean) + 1e-6)
        out[rest] = o.single + mine[place[rest]]
    alone = (count > 0) & (rank < o.single)
    out[alone] = rank[alone]
    return out


# -- training ---------------------------------------------------------------------------------------


def schedule(total: int, o: ModelOptions) -> tuple[int, int]:
    """How many of ``rounds`` equal parts of a corpus of ``total`` ids a round reads, and how often: one unless the corpus is small."""
    passes = max(1, -(-o.steps * o.batch * o.window // max(1, total)))
    return min(passes, o.rounds), -(-passes // o.rounds)


def learn(p: dict[str, np.ndarray], texts: Iterable[np.ndarray], end: int, o: ModelOptions, turn: int, seed: int = 0, repeats: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """One round over ``texts``, every id of which is predicted ``repeats`` times: changes of all ``as_rows``, and their weights.

    The weight of an embedding is how often its id was read, that of other parameters how many ids there were.
    """
    rng = np.random.default_rng((turn, seed))
    of = p["classes"].astype(np.int32)
    names = [n for n in p if n not in ("embed", "classes")]
    embed, rest = p["embed"].copy(), np.concatenate([p[n].ravel() for n in names])
    now = {"embed": embed} | _parts(p, rest)
    table, flat = [embed, np.zeros_like(embed), np.zeros_like(embed)], [rest, np.zeros_like(rest), np.zeros_like(rest)]
    used = np.zeros(len(of), dtype=np.int64)
    rate = np.float32(o.rate * (1 - turn / o.rounds) + 1e-4)
    short = np.uint16 if len(of) <= 1 << 16 else np.int64  # numbers of two bytes are sorted by counting
    step = 0
    if repeats > 1:
        texts = list(texts) * repeats
    for ids in texts:
        if not len(ids):
            continue
        n = -(-len(ids) // o.window)
        # what is read at a place comes before what is predicted there; places past the end read the last id again
        line = np.concatenate([[end], ids, np.repeat(ids[-1:], n * o.window - len(ids))]).astype(np.int32)
        reads, targets = line[:-1].reshape(n, -1), line[1:].reshape(n, -1)
        for at in range(0, len(ids), 1 << 20):
            used += np.bincount(line[at : min(len(ids), at + (1 << 20))], minlength=len(of))
        begin = rng.permutation(n)
        for i in range(0, n, o.batch):
            rows = begin[i : i + o.batch]
            read, target = reads[rows], of[targets[rows]]
            if len(ids) < n * o.window:
                target[rows == n - 1, len(ids) - n * o.window :] = -1
            _, grads, dx = _gradients(now, read, target, measured=False)
            key = read.ravel().astype(short)
            sort = np.argsort(key, kind="stable")
            order = key[sort]
            begins = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
            touched = order[begins].astype(np.intp)
            step += 1
            warm = rate * np.float32(min(1, step / 20) if turn == 0 else 1)
            # embeddings that were not read stay as they are
            mine = [v.take(touched, 0) for v in table]
            _adam(*mine, np.add.reduceat(dx.take(sort, 0), begins), warm, step)
            for whole, v in zip(table, mine):
                whole[touched] = v
            _adam(*flat, np.concatenate([grads[n].ravel() for n in names]), warm, step)
    before = as_rows(p)
    weight = np.concatenate([used, np.full(len(before) - len(used), used.sum())]).astype(np.float64)
    return as_rows(now) - before, weight


def _adam(now: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, rate: np.float32, step: int) -> None:
    """A step of Adam in place."""
    by = g - first
    by *= np.float32(0.1)
    first += by
    np.multiply(g, g, out=by)
    by -= second
    by *= np.float32(0.01)
    second += by
    np.divide(second, np.float32(1 - 0.99**step), out=by)
    np.sqrt(by, out=by)
    by += np.float32(1e-8)
    np.divide(first, by, out=by)
    by *= rate / np.float32(1 - 0.9**step)
    now -= by


def _parts(p: dict[str, np.ndarray], rest: np.ndarray) -> dict[str, np.ndarray]:
    """Views of ``rest``, which holds all parameters but the embeddings one after the other."""
    out, at = {}, 0
    for n, v in p.items():
        if n not in ("embed", "classes"):
            out[n] = rest[at : at + v.size].reshape(v.shape)
            at += v.size
    return out


def as_rows(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows: the embeddings, and the others one after the other."""
    width = p["embed"].shape[1]
    rest = np.concatenate([v.ravel() for n, v in p.items() if n not in ("embed", "classes")])
    return np.concatenate([p["embed"], np.append(rest, np.zeros(-len(rest) % width, np.float32)).reshape(-1, width)])


def moved(p: dict[str, np.ndarray], change: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters with ``change`` added to their ``as_rows``."""
    rows = as_rows(p) + change
    return {"embed": rows[: len(p["embed"])]} | _parts(p, rows[len(p["embed"]) :].ravel()) | {"classes": p["classes"]}


def begun(count: np.ndarray, pairs: np.ndarray, times: np.ndarray, o: ModelOptions) -> dict[str, np.ndarray]:
    """Classes, and parameters before the first round."""
    return start(len(count), o, np.random.default_rng(0)) | {"classes": classes(count, pairs, times, o)}


def train(texts: list[np.ndarray], vocabulary: int, end: int, o: ModelOptions) -> dict[str, np.ndarray]:
    """Parameters and classes from the ids of some texts, all held by one."""
    parts = [np.concatenate([np.append(t, end) for t in part]).astype(np.int64) for k in range(o.rounds) if (part := texts[k :: o.rounds])]
    count = np.bincount(np.concatenate(parts), minlength=vocabulary)
    place, rank = clustered(count, o)
    (pairs, times), = neighbours(parts, place, rank, end, o)
    p = begun(count, pairs, times, o)
    share, repeats = schedule(int(count.sum()), o)
    for turn in range(o.rounds):
        change, _ = learn(p, [parts[(turn * share + k) % len(parts)] for k in range(share)], end, o, turn, 0, repeats)
        p = moved(p, change)
    return p


def untrained(vocabulary: int, o: ModelOptions) -> dict[str, np.ndarray]:
    """Gives all classes equal chances."""
    p = start(vocabulary, o, np.random.default_rng(0))
    return {n: np.zeros_like(v) for n, v in p.items()} | {"classes": np.arange(vocabulary) % (o.single + o.clusters)}


def save(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def within(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10 of an id's share in its class, every id counted half a time more."""
    c = counts + 0.5
    return np.log10(c) - np.log10(np.bincount(of, c))[of]


def windows(first: np.ndarray, o: ModelOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin, how many inputs they have, and from which on targets are theirs: each target once."""
    size = np.diff(first)
    stride = o.window - o.overlap
    more = np.maximum(0, -(-(size - o.window) // stride))
    count = np.where(size > 0, 1 + more, 0)
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][row] + number * stride
    length = np.minimum(o.window, first[1:][row] - begin)
    return begin, length, np.where(number > 0, o.overlap, 0)


def log10_scores(p: dict[str, np.ndarray], share: np.ndarray, sequence: np.ndarray, first: np.ndarray, end: int, o: ModelOptions, batch: int = CHUNK) -> np.ndarray:
    """log10 probability of each text; ``sequence`` holds the ids of all texts, each with its end."""
    found = log10_places(p, share, sequence, first, end, o, batch)
    return np.diff(np.concatenate([[0.0], np.cumsum(found)])[first])


def log10_places(p: dict[str, np.ndarray], share: np.ndarray, sequence: np.ndarray, first: np.ndarray, end: int, o: ModelOptions, batch: int = CHUNK) -> np.ndarray:
    """log10 probability of every id of all texts, given those before it in its window."""
    past = len(sequence)  # a place of its own for what a window has past its end, which only follows what is scored
    inputs = np.zeros(past + 1, dtype=np.int32)
    inputs[1:past] = sequence[:-1]
    inputs[first[:-1][np.diff(first) > 0]] = end
    inputs[past] = end
    begin, length, new = windows(first, o)
    found = np.zeros(past + 1)
    goals = np.append(p["classes"].astype(np.int32).take(sequence), np.int32(0))
    m = fused(p)
    place, unit, tens = np.arange(o.window), np.float32(1 / UNIT), np.float32(1 / np.log(10))
    with np.errstate(over="ignore", invalid="ignore"):
        for since in np.unique(new).tolist():
            mine = np.flatnonzero(new == since)
            for i in range(0, len(mine), batch):
                b, n = begin[mine[i : i + batch], None], length[mine[i : i + batch], None]
                at = b + place
                if n.min() < o.window:
                    at[place >= n] = past
                goal = at[:, since:].ravel()
                _, sums, right, _ = _class_powers(m, states(p, m, inputs.take(at), since)["g"], goals.take(goal))
                found[goal] = (right * unit - np.log(sums)) * tens
    found = found[:past]
    found += share.take(sequence)
    return found
