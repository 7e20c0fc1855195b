"""A character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding.

Small on purpose: characters fall into a few classes, each direction has ``HIDDEN`` units, and windows of
equal length are worked on together, character by character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: no personal data
HIDDEN = 6

# Characters with a class of their own; the others share one for each kind.
OWN = "@.-+() %_:/,'\"\n\t#*="
PAD, DIGIT, LOWER, UPPER, LETTER, OTHER = range(6)
CLASSES = 6 + len(OWN)


def _class_table() -> np.ndarray:
    table = np.full(0x250, OTHER, np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c in OWN:
            table[code] = 6 + OWN.index(c)
        elif "0" <= c <= "9":
            table[code] = DIGIT
        elif "a" <= c <= "z":
            table[code] = LOWER
        elif "A" <= c <= "Z":
            table[code] = UPPER
        elif c.isalpha():
            table[code] = LETTER
    table[-1] = LETTER  # for all code points beyond
    return table


CLASS_OF = _class_table()


def classes(text: str) -> np.ndarray:
    """Class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS_OF[np.minimum(codes, len(CLASS_OF) - 1)]


@dataclass
class Tagger:
    """Weights. Gates are in the order input, forget, output, candidate; [0] reads on, [1] reads back."""

    inputs: np.ndarray  # 2, 4 * HIDDEN, CLASSES
    states: np.ndarray  # 2, 4 * HIDDEN, HIDDEN
    emits: np.ndarray  # 2, LABELS, HIDDEN
    bias: np.ndarray  # LABELS
    moves: np.ndarray  # from label, to label

    @classmethod
    def drawn(cls, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape)
        inputs = draw(2, 4 * HIDDEN, CLASSES)
        inputs[:, HIDDEN : 2 * HIDDEN] += 1.0
        return cls(
            inputs,
            draw(2, 4 * HIDDEN, HIDDEN),
            draw(2, LABELS, HIDDEN),
            np.zeros(LABELS),
            np.zeros((LABELS, LABELS)),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.emits, self.bias, self.moves]

    # -- decoding ------------------------------------------------------------------------

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores, as (steps, LABELS, windows), for class numbers (steps, windows).

        Sigmoids are taken as (1 + tanh(z / 2)) / 2, with the constants moved into the weights;
        cells and outputs are kept doubled. Padding has closed gates, so its state is zero.
        """
        steps, size = x.shape
        scale = np.repeat([0.5, 0.5, 0.5, 1.0], HIDDEN)[:, None]
        inputs = (self.inputs * scale).astype(np.float32)
        inputs[:, : 3 * HIDDEN, PAD] = -1e4
        states = (self.states * scale * 0.5).astype(np.float32)
        emits = (self.emits * 0.5).astype(np.float32)
        out = np.empty((steps, LABELS, size), np.float32)
        out[:] = self.bias.astype(np.float32)[:, None]
        h = np.zeros((2, HIDDEN, size), np.float32)
        c = np.zeros_like(h)
        t = np.empty_like(h)
        z = np.empty((2, 4 * HIDDEN, size), np.float32)
        fed = np.empty_like(z)
        gates, i, f, o, g = (
            z[:, : 3 * HIDDEN], z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN],
            z[:, 2 * HIDDEN : 3 * HIDDEN], z[:, 3 * HIDDEN :],
        )
        for step in range(steps):
            back = steps - 1 - step
            np.take(inputs[0], x[step], axis=1, out=fed[0], mode="clip")
            np.take(inputs[1], x[back], axis=1, out=fed[1], mode="clip")
            np.matmul(states, h, out=z)
            z += fed
            np.tanh(z, out=z)
            gates += 1
            c *= f
            c *= 0.5
            i *= g
            c += i
            np.multiply(c, 0.5, out=t)
            np.tanh(t, out=t)
            np.multiply(o, t, out=h)
            out[step] += emits[0] @ h[0]
            out[back] += emits[1] @ h[1]
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best labels (steps, windows) for class numbers (steps, windows).

        Where no label can make up for what it costs to leave and to come back, the best path is
        all zeros, and no search is needed; that bound is exact.
        """
        scores = self.emissions(x)
        best = np.zeros(x.shape, np.uint8)
        moves = self.moves.astype(np.float32)
        enter = moves[:, 1:].max() - moves[0, 0]
        leave = max(0.0, moves[1:, 0].max() - moves[0, 0])
        lead = scores[:, 1:].max(axis=1)
        lead -= scores[:, 0]
        open_ = np.flatnonzero(lead.max(axis=0) + enter + leave >= -1e-3)
        if len(open_):
            best[:, open_] = self._viterbi(scores[:, :, open_], moves)
        best[x == PAD] = 0
        return best

    @staticmethod
    def _viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
        steps, _, size = scores.shape
        came = np.empty((steps, LABELS, size), np.uint8)
        total = scores[0]
        for step in range(1, steps):
            paths = total[:, None] + moves[:, :, None]
            came[step] = paths.argmax(axis=0)
            total = paths.max(axis=0) + scores[step]
        best = np.empty((steps, size), np.uint8)
        best[-1] = total.argmax(axis=0)
        at = np.arange(size)
        for step in range(steps - 1, 0, -1):
            best[step - 1] = came[step][best[step], at]
        return best

    # -- training ------------------------------------------------------------------------

    def _run(self, x: np.ndarray):
        """Emissions and all gates, cells and outputs, in double precision, for training."""
        steps, size = x.shape
        h = np.zeros((steps + 1, 2, HIDDEN, size))
        c = np.zeros_like(h)
        gates = np.empty((steps, 2, 4 * HIDDEN, size))
        scores = np.tile(self.bias[:, None], (steps, 1, size))
        for step in range(steps):
            back = steps - 1 - step
            z = self.states @ h[step]
            z[0] += self.inputs[0][:, x[step]]
            z[1] += self.inputs[1][:, x[back]]
            z[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            gates[step] = z
            i, f, o, g = np.split(z, 4, axis=1)
            c[step + 1] = f * c[step] + i * g
            h[step + 1] = o * np.tanh(c[step + 1])
            scores[step] += self.emits[0] @ h[step + 1, 0]
            scores[back] += self.emits[1] @ h[step + 1, 1]
        return scores, gates, c, h

    def _crf(self, scores: np.ndarray, labels: np.ndarray):
        """Loss, and its gradients by emissions and moves: marginals less what the labels say."""
        steps, _, size = scores.shape
        at = np.arange(size)
        on, back = np.empty_like(scores), np.empty_like(scores)
        on[0], back[-1] = scores[0], 0.0
        logsum = lambda a: (m := a.max(axis=0)) + np.log(np.exp(a - m).sum(axis=0))
        for step in range(1, steps):
            on[step] = scores[step] + logsum(on[step - 1][:, None] + self.moves[:, :, None])
        for step in range(steps - 2, -1, -1):
            ahead = scores[step + 1] + back[step + 1]
            back[step] = logsum(ahead[:, None] + self.moves.T[:, :, None])
        total = logsum(on[-1])
        d_scores = np.exp(on + back - total)
        pairs = (
            on[:-1, :, None] + self.moves[None, :, :, None] + (scores + back)[1:, None] - total
        )
        d_moves = np.exp(pairs).sum(axis=(0, 3))
        loss = total.sum()
        for step in range(steps):
            d_scores[step, labels[step], at] -= 1
            loss -= scores[step, labels[step], at].sum()
        np.subtract.at(d_moves, (labels[:-1], labels[1:]), 1)
        loss -= self.moves[labels[:-1], labels[1:]].sum()
        return loss / size, d_scores / size, d_moves / size

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss per window, and the gradients of all weights, by going back through the steps."""
        scores, gates, c, h = self._run(x)
        loss, d_scores, d_moves = self._crf(scores, labels)
        d_inputs, d_states = np.zeros_like(self.inputs), np.zeros_like(self.states)
        d_emits = np.zeros_like(self.emits)
        steps = len(x)
        d_h, d_c = np.zeros(h.shape[1:]), np.zeros(h.shape[1:])
        for step in range(steps - 1, -1, -1):
            places = (step, steps - 1 - step)
            for way, place in enumerate(places):
                d_emits[way] += d_scores[place] @ h[step + 1, way].T
                d_h[way] += self.emits[way].T @ d_scores[place]
            i, f, o, g = np.split(gates[step], 4, axis=1)
            tanh = np.tanh(c[step + 1])
            d_c += d_h * o * (1 - tanh**2)
            d_z = np.concatenate(
                [d_c * g * i * (1 - i), d_c * c[step] * f * (1 - f), d_h * tanh * o * (1 - o),
                 d_c * i * (1 - g**2)], axis=1,
            )
            for way, place in enumerate(places):
                hot = np.zeros((CLASSES, x.shape[1]))
                hot[x[place], np.arange(x.shape[1])] = 1
                d_inputs[way] += d_z[way] @ hot.T
                d_states[way] += d_z[way] @ h[step, way].T
            d_h = np.einsum("wzh,wzb->whb", self.states, d_z)
            d_c = d_c * f
        return loss, [d_inputs, d_states, d_emits, d_scores.sum(axis=(0, 2)), d_moves]


def train(
    x: np.ndarray, labels: np.ndarray, epochs: int = 24, batch: int = 128, rate: float = 0.02, seed: int = 7
) -> Tagger:
    """Fit to windows (windows, steps) of classes and labels with Adam; the same on each run."""
    tagger = Tagger.drawn(seed)
    if not len(x):
        tagger.bias[0] = 50.0  # nothing to learn from: no spans
        return tagger
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in tagger.weights()]
    second = [np.zeros_like(w) for w in tagger.weights()]
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            rows = order[start : start + batch]
            _, found = tagger.gradients(x[rows].T, labels[rows].T)
            norm = np.sqrt(sum((g**2).sum() for g in found))
            turn += 1
            step = rate * (0.5 if epoch > epochs // 2 else 1.0)
            for w, g, m, v in zip(tagger.weights(), found, first, second, strict=True):
                g = g * min(1.0, 5.0 / (norm + 1e-12))
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return tagger
