"""Substitution and site-rate models: a model string becomes (Q, frequencies, rate classes), plain arrays for a kernel."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from cladeforge.functions.numerics import gamma_rates

#: DNA models as rate classes of AC AG AT CG CT GT, and whether their frequencies are equal.
DNA = {
    "JC": ("000000", True), "F81": ("000000", False), "K80": ("010010", True), "HKY": ("010010", False), "TNE": ("010020", True), "TN": ("010020", False), "K81": ("012210", True), "K81U": ("012210", False),
    "TPM2": ("010212", True), "TPM2U": ("010212", False), "TPM3": ("012012", True), "TPM3U": ("012012", False), "TIME": ("012230", True), "TIM": ("012230", False), "TIM2E": ("010232", True), "TIM2": ("010232", False),
    "TIM3E": ("012032", True), "TIM3": ("012032", False), "TVME": ("012314", True), "TVM": ("012314", False), "SYM": ("012345", True), "GTR": ("012345", False),
}
STATES = {"DNA": 4, "AA": 20, "BIN": 2}


@dataclass(frozen=True)
class Model:
    q: np.ndarray
    freqs: np.ndarray
    rates: np.ndarray = field(default_factory=lambda: np.ones(1))
    shares: np.ndarray = field(default_factory=lambda: np.ones(1))
    invariant: float = 0.0
    df: int = 0
    ascertainment: bool = False
    error: float = 0.0  # the chance that a state is read as another one

    def __post_init__(self) -> None:
        """Reversible models are taken apart once: Q = left diag(values) right."""
        root = np.sqrt(self.freqs)
        values, vectors = np.linalg.eigh(self.q * root[:, None] / root[None, :])
        object.__setattr__(self, "_parts", (vectors / root[:, None], values, vectors.T * root[None, :]))

    def p(self, t: float | np.ndarray) -> np.ndarray:
        """Transition probabilities after time t (an array of times gives one matrix each)."""
        left, values, right = self._parts
        return np.maximum(np.einsum("ik,...k,kj->...ij", left, np.exp(np.multiply.outer(np.asarray(t, float), values)), right), 0.0)


@dataclass(frozen=True)
class Irreversible(Model):
    """A model whose Q is any rate matrix; where the root stands matters."""

    def __post_init__(self) -> None:
        pass

    def p(self, t: float | np.ndarray) -> np.ndarray:
        times = np.asarray(t, float)
        out = np.array([expm(self.q * x) for x in times.ravel()]).reshape(*times.shape, *self.q.shape)
        return np.maximum(out, 0.0)


def expm(a: np.ndarray) -> np.ndarray:
    """The matrix exponential, by a Taylor series of a scaled matrix and squaring."""
    n = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    x, out = a / 2**n, np.eye(len(a))
    term = out
    for k in range(1, 14):
        term = term @ x / k
        out = out + term
    for _ in range(n):
        out = out @ out
    return out


def stationary(q: np.ndarray) -> np.ndarray:
    """The frequencies that a rate matrix leaves as they are."""
    a = np.vstack([q.T, np.ones(len(q))])
    return np.linalg.lstsq(a, np.append(np.zeros(len(q)), 1.0), rcond=None)[0]


def unrestricted(rates: list[float]) -> Model:
    """A model of twelve rates: AC AG AT CA CG CT GA GC GT TA TC TG, one substitution a time unit."""
    q = np.zeros((4, 4))
    q[~np.eye(4, dtype=bool)] = rates
    np.fill_diagonal(q, -q.sum(1))
    pi = stationary(q)
    return Irreversible(q / -(np.diag(q) * pi).sum(), pi, df=11)


def lie_markov_ry(a: float, b: float, c: float) -> Model:
    """The doubly symmetric strand-and-ring family over purines (A, G) and pyrimidines (C, T): rate `a` within a pair's partner of the same kind, `b` and `c` to the two
    states of the other kind, the nearer (A to C, G to T) first."""
    q = np.array([[0, b, a, c], [b, 0, c, a], [a, c, 0, b], [c, a, b, 0]], float)
    return Model(rate_matrix(4 * q, np.full(4, 0.25)), np.full(4, 0.25), df=2)


def rate_matrix(exchange: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Q of symmetric exchangeabilities and frequencies, scaled to one substitution a time unit."""
    q = exchange * freqs[None, :]
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(1))
    return q / -(np.diag(q) * freqs).sum()


def dna(code: str, rates: list[float] | None = None, freqs: np.ndarray | None = None) -> np.ndarray:
    """Q for six rate classes (a digit string); `rates` holds one for each class, 1 where missing."""
    r = [(rates or [])[int(c)] if rates and int(c) < len(rates) else 1.0 for c in code]
    s = np.zeros((4, 4))
    s[np.triu_indices(4, 1)] = r
    return rate_matrix(s + s.T, np.full(4, 0.25) if freqs is None else freqs)


def ordered(n: int) -> np.ndarray:
    """Morphological states that change step by step."""
    return rate_matrix(np.eye(n, k=1) + np.eye(n, k=-1), np.full(n, 1 / n))


def _numbers(text: str) -> list[float]:
    m = re.search(r"\{([^}]*)\}", text)
    return [float(x) for x in m[1].split(",") if x] if m else []


def parse(name: str, empirical: np.ndarray | None = None, n_states: int = 4) -> Model:
    """A model of a string like `GTR{1,2,1,1,2,1}+F+I{0.1}+G4{0.5}` or `HKY{2}+R2{0.5,0.5,0.5,1.5}`; parameters in braces, defaults else.

    Parts: base (a DNA name or six digits, UNREST with twelve rates, JC2/MK for equal rates, ORDERED), +F, +FO{..}, +FQ, +I, +G, +R, +ASC, +E (reading errors)."""
    base, *parts = re.split(r"\+(?![^{]*\})", name)
    label = re.sub(r"\{.*", "", base).upper()
    freqs, rates, shares, inv, df, asc, error = None, np.ones(1), np.ones(1), 0.0, 0, False, 0.0
    for p in parts:
        kind, values = re.sub(r"\{.*", "", p).upper(), _numbers(p)
        if kind in ("F", "FO"):
            freqs = np.array(values) if values else empirical
            df += n_states - 1
        elif kind == "FQ":
            freqs = np.full(n_states, 1 / n_states)
        elif kind == "I":
            inv, df = (values or [0.1])[0], df + 1
        elif kind[0] == "G" and kind[1:].isdigit() or kind == "G":
            rates = gamma_rates((values or [1.0])[0], int(kind[1:] or 4))
            shares, df = np.full(len(rates), 1 / len(rates)), df + 1
        elif kind[0] == "R":
            k = int(kind[1:] or 4)
            v = values or [x for i in range(k) for x in (1 / k, 2 * (i + 1) / (k + 1))]
            shares, rates, df = np.array(v[::2]), np.array(v[1::2]), df + 2 * k - 2
            rates = rates / (shares * rates).sum() * shares.sum()
        elif kind.startswith("ASC"):
            asc = True
        elif kind == "E":
            error, df = (values or [0.01])[0], df + 1
        else:
            raise ValueError(f"unknown model part +{p}")
    if label in DNA or re.fullmatch(r"[0-5]{6}", label):
        code, equal = DNA.get(label, (label, False))
        if freqs is None:
            freqs = np.full(4, 0.25) if equal or empirical is None else empirical
        values = _numbers(base)
        classes = len(set(code))
        order = list(dict.fromkeys(code))
        canon = "".join(str(order.index(c)) for c in code)
        first_free = classes - 1
        full = ([1.0, *values] if len(values) == first_free else values) or None
        q, df = dna(canon, full, freqs), df + first_free + (3 if not equal and not any(x.upper().startswith("F") for x in parts) else 0)
    elif label in ("JC2", "MK", "POISSON", "GTR2"):
        freqs = np.full(n_states, 1 / n_states) if freqs is None else freqs
        q = rate_matrix(np.ones((n_states, n_states)), freqs)
    elif label == "UNREST":
        base_model = unrestricted(_numbers(base) or [1.0] * 12)
        return Irreversible(base_model.q, base_model.freqs, rates / max(1 - inv, 1e-12), shares * (1 - inv), inv, df + 11, asc, error)
    elif label == "ORDERED":
        q, freqs = ordered(n_states), np.full(n_states, 1 / n_states)
    else:
        raise ValueError(f"unknown model {label}")
    return Model(q, np.asarray(freqs, float), rates / max(1 - inv, 1e-12), shares * (1 - inv), inv, df, asc, error)


def candidates(rates: tuple[str, ...] = ("", "+I", "+G4", "+I+G4")) -> list[str]:
    """The grid of DNA models: names, empirical frequencies where they are free, site rates."""
    return [f"{m}{'' if equal else '+F'}{r}" for m, (_, equal) in DNA.items() for r in rates]


def from_triangle(values: list[float], freqs: list[float]) -> Model:
    """A reversible model of any number of states from a lower-triangular list of exchangeabilities, as empirical protein models are published."""
    n = len(freqs)
    s = np.zeros((n, n))
    s[np.tril_indices(n, -1)] = values
    f = np.asarray(freqs, float) / sum(freqs)
    return Model(rate_matrix(s + s.T, f), f)


def codon(kappa: float, omega: float, freqs: np.ndarray | None = None, code: str = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG") -> tuple[Model, list[str]]:
    """A model of sense codons that change one base at a time: transitions by `kappa`, changes of the amino acid by `omega`; and the codons, in T, C, A, G order."""
    words = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    sense = [i for i in range(64) if code[i] != "*"]
    s = np.zeros((len(sense), len(sense)))
    for x, i in enumerate(sense):
        for y, j in enumerate(sense):
            differ = [(a, b) for a, b in zip(words[i], words[j], strict=True) if a != b]
            if len(differ) == 1:
                s[x, y] = (kappa if set(differ[0]) in ({"A", "G"}, {"C", "T"}) else 1.0) * (1.0 if code[i] == code[j] else omega)
    f = np.full(len(sense), 1 / len(sense)) if freqs is None else freqs
    return Model(rate_matrix(s, f), f), [words[i] for i in sense]


def polymorphic(base: np.ndarray, freqs: np.ndarray, size: int, diversity: float) -> tuple[np.ndarray, np.ndarray]:
    """Q and stationary frequencies of populations of `size`: four fixed states, then for each pair of bases the counts 1 .. size - 1 of the first.

    Mutation leaves fixed states at the base model's rates; drift moves a count up or down by k (size - k) / size. `diversity` is the share of
    polymorphic states at equilibrium."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    at = {(i, j, k): 4 + p * (size - 1) + k - 1 for p, (i, j) in enumerate(pairs) for k in range(1, size)}
    n = 4 + len(pairs) * (size - 1)
    exchange = base / freqs[None, :]
    pi = np.zeros(n)
    pi[:4] = freqs
    for i, j in pairs:
        for k in range(1, size):
            pi[at[i, j, k]] = freqs[i] * freqs[j] * exchange[i, j] * (1 / k + 1 / (size - k))
    scale = diversity * pi[:4].sum() / ((1 - diversity) * pi[4:].sum())
    pi[4:] *= scale
    q = np.zeros((n, n))
    for i, j in pairs:
        for k in range(1, size):
            drift = k * (size - k) / size
            up, down = at.get((i, j, k + 1), i), at.get((i, j, k - 1), j)
            q[at[i, j, k], up], q[at[i, j, k], down] = drift, drift
        q[i, at[i, j, size - 1]] = pi[at[i, j, size - 1]] * q[at[i, j, size - 1], i] / pi[i]
        q[j, at[i, j, 1]] = pi[at[i, j, 1]] * q[at[i, j, 1], j] / pi[j]
    np.fill_diagonal(q, -q.sum(1))
    return q, pi / pi.sum()
