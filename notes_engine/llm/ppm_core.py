"""Static PPM (estimated escapes, full symbol exclusion) over packed byte grams.

A gram is one coded symbol with the bytes before it.  It is packed in an
unsigned 64-bit integer: bits 0-7 hold the symbol, bits 8-15 the byte just
before it, bits 16-23 the byte before that, and so on, up to ``MAX_ORDER``
context bytes.  The number of context bytes is kept beside it, since a context
may be clipped.

Counts of an order-k context are sums over all grams whose context ends in it,
so the symbols of a context are a subset of those of each of its suffixes.
What symbol exclusion removes at an order, after an escape from the last longer
context that was not passed over, is therefore a property of that context alone,
and whole arrays of grams can be coded at once.

Escapes are estimated from the training counts with one occurrence left out: a
symbol that a context has once would be an escape if it were new.  Such cases
are counted by order, occurrences and symbols of the context (``escape_cases``).
"""

from __future__ import annotations

import numpy as np

MAX_ORDER = 6
TRUST = 3.0  # occurrences of a context for each of its symbols, below which it is passed over
SHARD_ORDER = 2  # grams that share so many last context bytes are coded together


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def _sums(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the index of each id among them, and the sum of weights for each."""
    keys, at = np.unique(ids, return_inverse=True)
    return keys, at, np.bincount(at, weights=weights, minlength=len(keys))


class LowOrders:
    """Orders 1 and 0: at most 256 x 256 counts, whatever the corpus holds."""

    def __init__(self, pairs: np.ndarray):
        self.c1 = pairs.astype(np.float64)  # [previous byte, symbol]
        self.n1, self.d1 = self.c1.sum(1), (self.c1 > 0).sum(1)
        self.c0 = self.c1.sum(0)
        self.n0, self.d0 = self.c0.sum(), (self.c0 > 0).sum()
        self.e1 = (self.c1 > 0) @ self.c0  # what exclusion takes from order 0


N_BINS, D_BINS = 18, 12


def _bins(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The class of contexts with n occurrences of d symbols."""
    nb = np.minimum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), N_BINS - 1)
    db = np.where(d <= 4, d, 3 + np.log2(np.maximum(d, 1))).astype(np.int64)
    return nb * D_BINS + np.clip(db, 0, D_BINS - 1)


def _cases(ctx_at: np.ndarray, pair_c: np.ndarray, ctx_n: np.ndarray, ctx_d: np.ndarray) -> np.ndarray:
    """Escapes and all cases of each class, from the pairs of one order, one occurrence left out."""
    out = np.zeros((2, N_BINS * D_BINS))
    ok = (pair_c > 0) & (ctx_n[ctx_at] > 1)
    c, n, d = pair_c[ok], ctx_n[ctx_at[ok]] - 1, ctx_d[ctx_at[ok]]
    single = c == 1
    at = _bins(n, d - single)
    out[0] = np.bincount(at[single], minlength=out.shape[1])
    out[1] = np.bincount(at, weights=c, minlength=out.shape[1])
    return out


def _pairs_of(keys, lengths, counts, k):
    """Grams with k context bytes or more: their indices, and their pairs and contexts of order k."""
    at_k = np.flatnonzero(lengths >= k)
    pair_keys, pair_at, pair_c = _sums(keys[at_k] & _mask(k + 1), counts[at_k])
    _, ctx_at, ctx_n = _sums(pair_keys >> np.uint64(8), pair_c)
    ctx_d = np.bincount(ctx_at, weights=pair_c > 0, minlength=len(ctx_n))
    return at_k, pair_keys, pair_at, pair_c, ctx_at, ctx_n, ctx_d


def escape_cases(keys: np.ndarray, lengths: np.ndarray, counts: np.ndarray, order: int = MAX_ORDER) -> np.ndarray:
    """Cases of a shard for each order from ``SHARD_ORDER`` on: [order, 2, class]."""
    out = np.zeros((order + 1, 2, N_BINS * D_BINS))
    for k in range(SHARD_ORDER, order + 1):
        if (lengths >= k).any():
            _, _, _, pair_c, ctx_at, ctx_n, ctx_d = _pairs_of(keys, lengths, counts.astype(np.float64), k)
            out[k] = _cases(ctx_at, pair_c, ctx_n, ctx_d)
    return out


def escape_table(cases: np.ndarray, low: LowOrders) -> np.ndarray:
    """Escape probability by order and class; where there are few cases, that of half a count for each symbol."""
    cases = cases.copy()
    row, _ = np.nonzero(low.c1)
    cases[1] = _cases(row, low.c1[low.c1 > 0], low.n1, low.d1)
    cases[0] = _cases(np.zeros(int((low.c0 > 0).sum()), np.int64), low.c0[low.c0 > 0], np.array([low.n0]), np.array([low.d0]))
    n = 2.0 ** (np.arange(N_BINS) + 0.5)
    d = np.array([0, 1, 2, 3, 4, *(2.0 ** (k - 2.5) for k in range(5, D_BINS))])
    prior = np.clip(d[None] / (2 * n[:, None]), 1e-6, 0.5).ravel()
    return np.clip((cases[:, 0] + 4 * prior) / (cases[:, 1] + 4), 1e-7, 0.98)


def _step(live, logp, known, c, n, d, ex_n, ex_d, escapes):
    """Code at one order the grams that are still live; returns those that escape."""
    nn, dd = n - ex_n, d - ex_d
    some = live & known & (nn > 0)
    esc = np.zeros(len(c))
    esc[some] = escapes[_bins(nn[some], dd[some])]
    hit = some & (c > 0)
    logp[hit] += np.log10((1 - esc[hit]) * (c[hit] - 0.5) / (nn[hit] - 0.5 * dd[hit]))
    out = some & ~hit
    logp[out] += np.log10(esc[out])
    return live & ~hit


def _byte(keys: np.ndarray, i: int) -> np.ndarray:
    return ((keys >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64)


def _exclude(ex_n, wanted, last, above, count_of) -> None:
    """Set what exclusion takes, in counts of the order now coded, from the symbols of each gram's last context."""
    for k, (grams, gram_ctx, pair_keys, pair_ctx) in above.items():
        here = wanted[grams] & (last[grams] == k)
        if here.any():
            needed = np.zeros(int(gram_ctx.max()) + 1, bool)
            needed[gram_ctx[here]] = True
            some = needed[pair_ctx]
            taken = np.bincount(pair_ctx[some], weights=count_of(pair_keys[some]), minlength=len(needed))
            ex_n[grams[here]] = taken[gram_ctx[here]]


def code_shard(keys: np.ndarray, lengths: np.ndarray, counts: np.ndarray, low: LowOrders, escapes: np.ndarray, order: int = MAX_ORDER) -> np.ndarray:
    """log10 probability of each distinct gram of one shard.

    ``keys`` (uint64), ``lengths`` and ``counts`` (0 for grams that only occur
    outside the training texts) hold every gram of the corpus whose context ends
    in the shard's ``SHARD_ORDER`` bytes, or, for shorter contexts, any grams.
    """
    m = len(keys)
    logp, live = np.zeros(m), np.ones(m, bool)
    ex_n, ex_d, last = np.zeros(m), np.zeros(m), np.zeros(m, np.int64)  # last: order of the context escaped from
    above = {}  # by order: grams, their contexts; pairs that occur, their contexts
    sym, b1 = (keys & np.uint64(255)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    counts = counts.astype(np.float64)
    for k in range(order, 0, -1):
        if k >= SHARD_ORDER:
            if not (lengths >= k).any():
                continue
            at_k, pair_keys, pair_at, pair_c, ctx_at, ctx_n, ctx_d = _pairs_of(keys, lengths, counts, k)
            gram_ctx = ctx_at[pair_at]
            c, n, d = np.zeros(m), np.zeros(m), np.zeros(m)
            c[at_k], n[at_k], d[at_k] = pair_c[pair_at], ctx_n[gram_ctx], ctx_d[gram_ctx]
            count_of = lambda keys, k=k, own=pair_keys, counts=pair_c: counts[np.searchsorted(own, keys & _mask(k + 1))]
        else:
            has = lengths >= 1
            c, n, d = (np.where(has, x, 0) for x in (low.c1[b1, sym], low.n1[b1], low.d1[b1]))
            count_of = lambda keys: low.c1[_byte(keys, 1), _byte(keys, 0)]
        known = n >= np.maximum(TRUST * d, 1)
        _exclude(ex_n, live & known, last, above, count_of)
        live = _step(live, logp, known, c, n, d, ex_n, ex_d, escapes[k])
        last, ex_d = np.where(known, k, last), np.where(known, d, ex_d)
        if k >= SHARD_ORDER:
            above[k] = at_k, gram_ctx, pair_keys[pair_c > 0], ctx_at[pair_c > 0]
    known = np.full(m, low.n0 > 0)
    _exclude(ex_n, live & known, last, above, lambda keys: low.c0[_byte(keys, 0)])
    ex_n = np.where(last == 1, low.e1[b1], ex_n)
    live = _step(live, logp, known, low.c0[sym], np.full(m, low.n0), np.full(m, float(low.d0)), ex_n, ex_d, escapes[0])
    logp[live] -= np.log10(256 - low.d0)
    return logp
