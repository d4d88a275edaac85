"""Pruning and its parts over one matrix in memory, by recounting: what the tables' results are held against."""

import numpy as np

from tessella.functions.keyed import keys, sent
from tessella.operators import null as nulls
from tessella.plans.pruning import ALGORITHMS


def bump(o: np.ndarray) -> np.ndarray:
    """Counts (taxa, states), one more everywhere if some is zero."""
    return o + 1 if (o == 0).any() else o


def matrix_counts(x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(x == c).sum(axis=1) for c in range(n)], axis=1).astype(float)


def matrix_chi2(o: np.ndarray) -> np.ndarray:
    share = o.sum(axis=0) / o.sum() if o.sum() else o.sum(axis=0)
    e = np.outer(o.sum(axis=1), share)
    e = e + 1 if (e == 0).any() else e
    return ((o - e) ** 2 / e).sum(axis=1)


def permute(x: np.ndarray, seed: int, sites: np.ndarray | None = None) -> np.ndarray:
    """Each column sent to other taxa by its own key; sites are the columns' names."""
    sites = np.arange(x.shape[1]) if sites is None else sites
    to = sent(np.broadcast_to(np.arange(len(x))[:, None], x.shape), len(x), np.broadcast_to(keys(seed, sites), x.shape))
    out = np.empty_like(x)
    np.put_along_axis(out, to, x, axis=0)
    return out


class Null:
    """The permutation null of a matrix, and what scoring needs of it."""

    def __init__(self, x: np.ndarray, n: int, permutations: int, algorithm: str, delta_null: bool, seed: int = nulls.SEED, sites: np.ndarray | None = None):
        table = np.stack([matrix_chi2(bump(matrix_counts(permute(x, seed + i, sites), n))) for i in range(permutations)])
        self.table, self.sums, self.pool = table, table.sum(axis=1), table.ravel()
        self.mean = self.pool.mean()
        self.scale = np.median(np.abs(self.pool - np.median(self.pool))) / nulls.MAD_SCALE
        if algorithm == "wasserstein" and self.scale == 0:
            raise ValueError("the null has no spread, so Z scores do not exist; use another algorithm")
        self.k = min(200, self.pool.size)
        self.at = np.arange(1, self.k + 1) / (self.k + 1)
        self.q = np.quantile((self.pool - self.mean) / self.scale, self.at) if self.scale else None
        deep = int(np.floor(nulls.SIGNIFICANT * self.pool.size / x.shape[0]))
        place = self.pool.size - deep - 1
        self.tau = np.sort(self.pool)[place] if 0 <= place < self.pool.size else np.inf
        self.max_delta = None
        if delta_null:
            shuffled = (permute(x, seed + permutations + i, sites) for i in range(permutations))
            self.max_delta = np.array([deltas(y, bump(matrix_counts(y, n)), n, algorithm, self)[1].max() for y in shuffled])

    def score(self, chi2: np.ndarray, algorithm: str) -> np.ndarray:
        """The score of each row of chi2 (..., taxa)."""
        if algorithm == "wasserstein":
            seen = np.quantile((chi2 - self.mean) / self.scale, self.at, axis=-1)
            return np.abs(np.moveaxis(seen, 0, -1) - self.q).mean(axis=-1)
        return (chi2 if algorithm == "squared" else chi2**2).sum(axis=-1)

    def p_of(self, total: float) -> float:
        return float((self.sums >= total).mean())


def deltas(x: np.ndarray, o: np.ndarray, n: int, algorithm: str, null: Null) -> tuple[float, np.ndarray]:
    """The score of counts o and how much each column's removal lowers it, every one recounted."""
    base, out = float(null.score(matrix_chi2(o), algorithm)), []
    for j in range(x.shape[1]):
        less = o.copy()
        for t in np.flatnonzero(x[:, j] >= 0):
            less[t, x[t, j]] -= 1
        out.append(base - float(null.score(matrix_chi2(less), algorithm)))
    return base, np.array(out)


def robust(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    scale = np.median(np.abs(pool - np.median(pool))) / nulls.MAD_SCALE
    d = x - pool.mean()
    return d / scale if scale else np.where(d == 0, 0.0, np.sign(d) * np.inf)


def corrected(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    ge = pool.size - np.searchsorted(np.sort(pool), x, side="left")
    return np.clip(ge / pool.size * x.size, 0, 1)


def prune_matrix(x: np.ndarray, n: int, algorithm: str = "wasserstein", most: int = 100, permutations: int = 100, top_n: int = 1, delta_null: bool = True, recomputes: int | None = 1) -> dict:
    """Take out the columns that cause bias, in batches, until none is justified.

    Returns log rows, scores before and after, the columns that stay, the reason to stop, and the null.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    first = null = Null(x, n, permutations, algorithm, delta_null)
    alive, batch, log = np.arange(x.shape[1]), [], []
    fine, level = max(1, top_n // 10), 0.95 if delta_null else nulls.SIGNIFICANT
    turn, done, used, last_size, calm, reason = 0, 0, 0, None, False, None
    chi2 = before = matrix_chi2(bump(matrix_counts(x, n)))

    def record(total: float, biased: int) -> None:
        for col, score, delta, p in batch:
            log.append((turn, col, total, score, delta, biased, p))

    def roll_back() -> bool:
        nonlocal alive, batch, calm, top_n, done
        if calm or top_n <= fine or not batch:
            return False
        back = {b[0] for b in batch}
        log[:] = [r for r in log if r[1] not in back]
        alive = np.array(sorted({*alive.tolist(), *back}))
        done, batch, calm, top_n = done - len(back), [], True, fine
        return True

    def renew() -> bool:
        nonlocal null, used, last_size, batch
        if turn == 0 or len(alive) == last_size or (recomputes is not None and used >= recomputes):
            return False
        null = Null(x[:, alive], n, permutations, algorithm, delta_null, sites=alive)
        used, last_size, batch = used + 1, len(alive), []
        return True

    while done + len(batch) < most and len(alive):
        o = bump(matrix_counts(x[:, alive], n))
        chi2 = matrix_chi2(o)
        total, biased = float(chi2.sum()), int((chi2 > null.tau).sum())
        p = null.p_of(total)
        record(total, biased)
        done += len(batch)
        if p > level:
            rolled = roll_back()
            if renew() or rolled:
                continue
            reason = "alignment p-value"
            batch = []
            break
        score, d = deltas(x[:, alive], o, n, algorithm, null)
        order = sorted(range(len(d)), key=lambda j: (-round(d[j], 9), j))[:top_n]
        chosen = []
        for j in order:
            q = None if null.max_delta is None else float((null.max_delta >= d[j]).mean())
            if q is not None and q > nulls.SIGNIFICANT:
                break
            chosen.append((int(alive[j]), score, float(d[j]), q))
        if not chosen:
            if renew():
                continue
            reason = f"delta not significant (p={(null.max_delta >= d[order[0]]).mean():.3f}, max_delta={d[order[0]]:.6f})"
            batch = []
            break
        if len(chosen) < len(order):
            rolled = roll_back()
            if renew() or rolled:
                continue
        batch = chosen
        gone = {b[0] for b in batch}
        alive = alive[~np.isin(alive, list(gone))]
        turn += 1
    else:
        if batch:
            chi2 = matrix_chi2(bump(matrix_counts(x[:, alive], n)))
            record(float(chi2.sum()), int((chi2 > null.tau).sum()))
        reason = f"reached --max_residue_pruned cap ({most})" if len(alive) else "no columns left"
    return {"log": log, "before": before, "after": chi2, "alive": alive, "reason": reason, "recomputes": used, "null": first, "last": null}


def parse_fasta(text: str) -> list[tuple[str, str]]:
    """(name, residues in capitals) of the records of a FASTA file's text, read line by line."""
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append(((line[1:].split() or [""])[0], []))
        elif line.strip():
            if not out:
                raise ValueError("a FASTA file starts with >")
            out[-1][1].append("".join(line.split()))
    return [(name, "".join(parts)) for name, parts in out]
