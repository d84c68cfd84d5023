"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of A - s I, read off the pivots of a factorisation P(A - s I)P' = L D L', tells how many
eigenvalues lie above s. Counts at the halves of an interval close in on the i-th largest one until it is
alone, and Rayleigh quotient iteration, started inside that interval, converges cubically to it. A last pair of
counts beside the found value certifies that it is number i. Eigenvalues that no shift can tell apart
in double precision are taken together as a basis of their common space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIVOT = (1 + 17 ** 0.5) / 8      # the share at which a single pivot bounds the growth of the factors
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Factors:
    """L, the blocks of D (1 or 2 wide) and the order of rows of one factorisation."""
    lower: np.ndarray
    blocks: list[tuple[int, np.ndarray]]
    order: np.ndarray

    @property
    def positive(self) -> int:
        """How many eigenvalues of D are positive; a block of two has one of each sign."""
        return sum(int(block[0, 0] > 0) if len(block) == 1 else 1 for _, block in self.blocks)

    def solve(self, right: np.ndarray, tiny: float) -> np.ndarray:
        """The solution; pivots below `tiny`, as at a shift on an eigenvalue, count as `tiny`."""
        x = right[self.order].copy()
        n = len(x)
        for k in range(n):
            x[k + 1:] -= np.multiply.outer(self.lower[k + 1:, k], x[k])
        for at, block in self.blocks:
            if len(block) == 1:
                pivot = block[0, 0]
                x[at] /= pivot if abs(pivot) >= tiny else (tiny if pivot >= 0 else -tiny)
            else:
                x[at:at + 2] = np.linalg.solve(block, x[at:at + 2])
        for k in range(n - 1, -1, -1):
            x[k] -= self.lower[k + 1:, k] @ x[k + 1:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def factor(matrix: np.ndarray) -> Factors:
    """Symmetric indefinite factorisation with complete pivoting by single rows or pairs of rows."""
    a, n = matrix.copy(), len(matrix)
    lower, order, blocks, k = np.eye(n), np.arange(n), [], 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            lower[[i, j], :k] = lower[[j, i], :k]
            order[[i, j]] = order[[j, i]]
    while k < n:
        rest = np.abs(a[k:, k:])
        on = int(rest.diagonal().argmax())
        r, c = divmod(int(rest.argmax()), n - k)
        if rest[on, on] >= PIVOT * rest[r, c] or k == n - 1:
            swap(k, k + on)
            pivot = a[k, k]
            blocks.append((k, np.array([[pivot]])))
            if pivot != 0:
                lower[k + 1:, k] = a[k + 1:, k] / pivot
                a[k + 1:, k + 1:] -= np.multiply.outer(lower[k + 1:, k], a[k, k + 1:])
            k += 1
        else:
            low, high = sorted((r, c))
            swap(k, k + low)
            swap(k + 1, k + high)
            block = a[k:k + 2, k:k + 2].copy()
            blocks.append((k, block))
            lower[k + 2:, k:k + 2] = np.linalg.solve(block, a[k:k + 2, k + 2:]).T
            a[k + 2:, k + 2:] -= lower[k + 2:, k:k + 2] @ a[k:k + 2, k + 2:]
            k += 2
    return Factors(lower, blocks, order)


class Slices:
    """Counts of the eigenvalues above shifts, each shift factored once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = (matrix + matrix.T) / 2
        self.size = len(matrix)
        reach = np.abs(self.matrix).sum(1) - np.abs(self.matrix.diagonal())
        self.low, self.high = float((self.matrix.diagonal() - reach).min()), float((self.matrix.diagonal() + reach).max())
        self.norm = max(abs(self.low), abs(self.high))
        self.blur = 16 * self.size * EPS * self.norm       # shifts closer than this say the same
        self.known = {self.low - self.blur: self.size, self.high + self.blur: 0}

    def factors(self, shift: float) -> Factors:
        return factor(self.matrix - shift * np.eye(self.size))

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = self.factors(shift).positive
        return self.known[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The closest known shifts that have at least `number` and fewer than `number` eigenvalues above."""
        return (max(s for s, n in self.known.items() if n >= number), min(s for s, n in self.known.items() if n < number))

    def certified(self, value: float, first: int, last: int | None = None) -> bool:
        """Whether the counts beside `value` give it the numbers `first` to `last`."""
        margin = 4 * self.blur
        return self.above(value + margin) < first and self.above(value - margin) >= (last or first)

    def isolate(self, number: int, width: float = np.inf) -> tuple[float, float, int]:
        """An interval with eigenvalue `number` alone and at most `width` wide, or as narrow as can be; how many it holds."""
        while True:
            low, high = self.bracket(number)
            held = self.known[low] - self.known[high]
            if (held == 1 and high - low <= width) or high - low <= 2 * self.blur:
                return low, high, held
            self.above((low + high) / 2)


def _unit(vectors: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Orthonormal columns, also against `others`."""
    for _ in range(2):
        for o in others:
            vectors = vectors - np.multiply.outer(o, o @ vectors)
        vectors, _ = np.linalg.qr(vectors)
    return vectors


def _alone(slices: Slices, number: int, others: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration inside the interval of one eigenvalue; None where it has company."""
    width = np.inf
    while True:
        low, high, held = slices.isolate(number, width)
        if held > 1:
            return None
        vector = start / np.linalg.norm(start)
        value, tiny = (low + high) / 2, EPS * slices.norm
        for _ in range(2):                                # inverse iteration at the middle, to turn towards it
            vector = slices.factors(value).solve(vector, tiny)
            vector /= np.linalg.norm(vector)
        best = None
        for _ in range(30):
            value = float(vector @ slices.matrix @ vector)
            residual = float(np.linalg.norm(slices.matrix @ vector - value * vector))
            if best is not None and residual >= best[0]:
                break
            best = residual, value, vector
            vector = slices.factors(value).solve(vector, tiny)
            vector /= np.linalg.norm(vector)
        residual, value, vector = best
        if residual <= slices.blur and slices.certified(value, number):
            return value, _unit(vector[:, None], others)[:, 0]
        width = (high - low) / 4                          # it left for a neighbour: start closer
        if width <= slices.blur:
            return None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `most` eigenvalues, falling, and their unit eigenvectors as columns.

    The entry of largest size in an eigenvector is positive. Raises ArithmeticError when the counts
    contradict a number.
    """
    size = len(matrix)
    if not size or not np.any(matrix):
        return np.zeros(min(most, size)), np.eye(size)[:, :most]
    slices = Slices(np.asarray(matrix, float))
    start = np.random.default_rng(12).standard_normal((size, size if size < 8 else 8 + min(most, size)))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < min(most, size):
        number = len(values) + 1
        found = _alone(slices, number, vectors, start[:, number % start.shape[1]])
        if found is not None:
            values.append(found[0])
            vectors.append(found[1])
        else:
            low, high, held = slices.isolate(number, 2 * slices.blur)
            middle = (low + high) / 2
            taken = min(held, min(most, size) - len(values))
            solved, basis = slices.factors(middle), start[:, :taken] if taken <= start.shape[1] else np.eye(size)[:, :taken]
            for _ in range(4):
                basis = _unit(solved.solve(basis, EPS * slices.norm), vectors)
            inner, turn = np.linalg.eigh(basis.T @ slices.matrix @ basis)
            values += inner[::-1].tolist()
            vectors += list((basis @ turn)[:, ::-1].T)
            if not slices.certified(middle, number, len(values)):
                raise ArithmeticError(f"eigenvalue {number} is not where the counts place it")
    out = np.array(vectors).T
    signs = np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])
    return np.array(values), out * signs
