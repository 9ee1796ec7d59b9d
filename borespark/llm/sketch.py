"""Sketches of shingle sets: ProbMinHash registers and blocked MinHash minima (NumPy kernels)."""

from __future__ import annotations

import numpy as np

from borespark.llm.kernels import U64, mix, stream


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int, seed: int = 1) -> np.ndarray:
    """Registers [n_docs, registers] of the weighted sets given as distinct (doc, element) with weights.

    Each element draws the arrivals of a Poisson process whose rate is its weight; every arrival goes to
    a uniformly drawn register, which keeps the element that arrived first.  Two sets agree in a register
    with the probability Jaccard similarity of their weights.  An element stops as soon as its next
    arrival is later than the latest register of its document, so large sets cost about one arrival per
    element.  A register of an empty set is 0.
    """
    arrival = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(doc))
    live = np.arange(len(doc))
    salt, step = stream(seed, 1)[0], U64(0x9E3779B97F4A7C15)
    round_no, limit = 0, None
    while len(live):
        round_no += 1
        draw = mix(element[live] ^ (U64((int(salt) + int(step) * round_no) % (1 << 64))))
        gap = -np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        time[live] += gap
        if limit is not None:
            keep = time[live] <= limit[doc[live]]
            live, draw = live[keep], draw[keep]
            if not len(live):
                break
        register = ((mix(draw) >> U64(32)) * U64(registers)) >> U64(32)
        flat = doc[live] * registers + register.astype(np.int64)
        now = time[live]
        np.minimum.at(arrival, flat, now)
        won = arrival[flat] == now
        winner[flat[won]] = element[live][won]
        latest = arrival.reshape(n_docs, registers).max(axis=1) if round_no < 8 or round_no % 16 == 0 else latest
        limit = latest
        live = live[now <= limit[doc[live]]]
    return winner.reshape(n_docs, registers)


def band_keys(registers: np.ndarray, bands: int, rows: int, seed: int = 2) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers."""
    salts, out = stream(seed, bands), np.empty((len(registers), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(registers), salts[b], np.uint64)
        for r in range(rows):
            key = mix(key ^ registers[:, b * rows + r])
        out[:, b] = key
    return out


def prob_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    """The probability Jaccard similarity by its definition (for tests)."""
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in a.keys() | b.keys())
    return total
