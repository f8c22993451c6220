"""A gated recurrent unit with class-factored output, trained by truncated backpropagation, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 16
WINDOW = 32
#: Streams of a segment: as many as give STREAM_WINDOWS windows each, within these bounds.
LEAST_STREAMS, MOST_STREAMS, STREAM_WINDOWS = 16, 256, 64
RATE_DENSE, RATE_ROWS = 0.01, 0.2


@dataclass(frozen=True)
class Shape:
    """``words`` have an output of their own, in ``classes`` of neighbouring numbers that start at
    ``starts``; ``others`` further classes are outputs whose words are told apart outside."""

    words: int
    starts: tuple[int, ...]
    others: int

    @property
    def classes(self) -> int:
        return len(self.starts)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        """Output class of input numbers: words first, then the other classes."""
        inputs = np.arange(self.words + self.others)
        own = np.searchsorted(np.array(self.starts), inputs, side="right") - 1
        # Small numbers sort by counting.
        table = np.where(inputs < self.words, own, self.classes + inputs - self.words).astype(np.int16)
        return table[ids]

    def span(self, number: int) -> slice:
        ends = [*self.starts[1:], self.words]
        return slice(self.starts[number], ends[number])


Weights = dict[str, np.ndarray]


def initial(shape: Shape, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Weights:
    """Small random weights; output biases give the shares of ``counts`` (words, then other classes)."""
    draw = np.random.default_rng(seed)
    inputs = shape.words + shape.others

    def small(*size: int, scale: float) -> np.ndarray:
        return (draw.standard_normal(size) * scale).astype(np.float32)

    classes = np.bincount(shape.class_of(np.arange(inputs)), counts + 0.5, shape.classes + shape.others)
    return {
        "embed": small(inputs, hidden, scale=0.1),
        "inner": small(hidden, 3 * hidden, scale=hidden**-0.5),
        "state": small(hidden, 3 * hidden, scale=hidden**-0.5),
        "bias": np.zeros(3 * hidden, dtype=np.float32),
        "class": small(hidden, shape.classes + shape.others, scale=0.01),
        "class_bias": np.log(classes).astype(np.float32),
        "word": small(shape.words, hidden, scale=0.01),
        "word_bias": np.log(counts[: shape.words] + 0.5).astype(np.float32),
    }


def gates(pre: np.ndarray, state: np.ndarray, recur: np.ndarray) -> tuple[np.ndarray, ...]:
    """(new state, reset and update, candidate, recurrent part of the candidate) from input and state."""
    hidden = state.shape[1]
    turned = state @ recur
    both = turned[:, : 2 * hidden] + pre[:, : 2 * hidden]
    np.negative(both, out=both)
    np.exp(both, out=both)
    both += 1
    np.reciprocal(both, out=both)
    inner = turned[:, 2 * hidden :]
    candidate = both[:, :hidden] * inner
    candidate += pre[:, 2 * hidden :]
    np.tanh(candidate, out=candidate)
    new = state - candidate
    new *= both[:, hidden:]
    new += candidate
    return new, both, candidate, inner


def _bounded(rows: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no exponential of rows . state + bias can overflow or vanish; states are within -1 and 1."""
    reach = np.abs(rows).sum(axis=1)
    return bool(len(bias) and (bias + reach).max() < 60 and (bias - reach).max() > -60)


def _shares(logits: np.ndarray, bounded: bool) -> np.ndarray:
    """Softmax of each row, in place."""
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits = states @ weights
    logits += bias
    return logits


def log_probabilities(weights: Weights, shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of the class, and the word in it where it is a word, after each state."""
    classes = shape.class_of(targets)
    out = np.empty(len(targets), dtype=states.dtype)
    bounded = _bounded(weights["class"].T, weights["class_bias"])
    for at in range(0, len(targets), _ROWS):
        part = slice(at, at + _ROWS)
        out[part] = _log_share(_logits(states[part], weights["class"], weights["class_bias"]), classes[part], bounded)
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(shape.classes + 1))
    order = order[: cuts[-1]]
    states, targets, found = states[order], targets[order], out[order]
    for number in range(shape.classes):
        rows, span = slice(cuts[number], cuts[number + 1]), shape.span(number)
        if rows.start < rows.stop and span.stop - span.start > 1:
            logits = _logits(states[rows], weights["word"][span].T, weights["word_bias"][span])
            bounded = _bounded(weights["word"][span], weights["word_bias"][span])
            found[rows] += _log_share(logits, targets[rows] - span.start, bounded)
    out[order] = found
    return out


#: Rows whose logits are held at once, so that they stay in the processor's cache.
_ROWS = 2_048


def _log_share(logits: np.ndarray, own: np.ndarray, bounded: bool) -> np.ndarray:
    """Logarithm of each row's softmax at its own column."""
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    found = logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    return found - np.log(logits.sum(axis=1))


def score(weights: Weights, shape: Shape, texts: list[np.ndarray], end: int, rows: int = 4_096) -> np.ndarray:
    """Natural log-likelihood of each text of input numbers, its state carried from first to last."""
    hidden = weights["state"].shape[0]
    table = weights["embed"] @ weights["inner"] + weights["bias"]
    lengths = np.array([len(text) for text in texts])
    firsts = np.cumsum(lengths) - lengths
    tokens = np.concatenate([*texts, np.array([end])])
    order = np.argsort(-lengths, kind="stable")
    totals = np.zeros(len(texts))
    for at in range(0, len(order), rows):
        part = order[at : at + rows]
        own, first = lengths[part], firsts[part]
        state = np.zeros((len(part), hidden), dtype=np.float32)
        last = np.full(len(part), end, dtype=np.int64)
        begin = 0
        while begin < own[0]:
            alive = int((own > begin).sum())
            span = min(max(1, 65_536 // alive), int(own[0]) - begin)
            left = np.minimum(own[:alive] - begin, span)
            # A step holds the texts that are long enough for it, which are the first ones.
            live = alive - np.searchsorted(left[::-1], np.arange(span), side="right")
            ends = np.cumsum(live)
            step_of = np.repeat(np.arange(span), live)
            row_of = np.arange(ends[-1]) - np.repeat(ends - live, live)
            targets = tokens[first[row_of] + begin + step_of]
            states = np.empty((len(targets), hidden), dtype=np.float32)
            state, previous = state[:alive], last[:alive]
            for step in range(span):
                many, until = live[step], ends[step]
                state[:many] = gates(table[previous[:many]], state[:many], weights["state"])[0]
                states[until - many : until] = state[:many]
                previous = targets[until - many : until]
            last = tokens[first[:alive] + begin + left - 1]
            found = log_probabilities(weights, shape, states, targets)
            totals[part[:alive]] += np.bincount(row_of, found, alive)
            begin += span
    return totals


def streams(tokens: np.ndarray, end: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of ``count`` parallel streams that hold the tokens of texts one after the other.

    All streams have one length, so fewer than ``count`` tokens at the end are in none.
    """
    whole = np.concatenate([np.array([end]), tokens])
    count = max(1, min(count, len(whole) - 1))
    length = (len(whole) - 1) // count
    inputs = whole[: count * length].reshape(count, length)
    return inputs, whole[1 : count * length + 1].reshape(count, length)


class Trainer:
    """Weights that learn from one segment of tokens after another, with the step sizes they have reached.

    Windows of a segment carry the state, gradients end at a window. A text starts from an
    empty state, as in scoring: the state is cleared after ``end``.
    """

    def __init__(self, weights: Weights, shape: Shape, end: int):
        self.weights = {name: value.copy() for name, value in weights.items()}
        self.shape, self.end, self.turns, self.tokens = shape, end, 0, 0
        self.left = np.zeros(0, dtype=np.int64)
        dense = ("state", "inner", "bias", "class", "class_bias", "word_bias")
        self.squares = {name: np.zeros_like(weights[name]) for name in dense}
        self.means = {name: np.zeros_like(weights[name]) for name in dense}
        self.embed_squares = np.full(len(weights["embed"]), 1e-4, np.float32)
        self.word_squares = np.full(len(weights["word"]), 1e-4, np.float32)

    def segment(self, tokens: np.ndarray) -> None:
        """One pass over the tokens; the few that fill no step of all streams come with the next segment."""
        tokens = np.concatenate([self.left, tokens])
        count = len(tokens) // (WINDOW * STREAM_WINDOWS)
        inputs, targets = streams(tokens, self.end, min(max(count, LEAST_STREAMS), MOST_STREAMS))
        self.left = tokens[inputs.size :]
        self.tokens += inputs.size
        state = np.zeros((len(inputs), self.weights["state"].shape[0]), dtype=np.float32)
        for at in range(0, inputs.shape[1], WINDOW):
            state = self._window(inputs[:, at : at + WINDOW], targets[:, at : at + WINDOW], state)

    def finish(self) -> Weights:
        """The weights after what was left over, too."""
        while len(self.left):
            inputs, targets = streams(self.left, self.end, len(self.left))
            self.left = self.left[inputs.size :]
            self.tokens += inputs.size
            self._window(inputs, targets, np.zeros((len(inputs), self.weights["state"].shape[0]), dtype=np.float32))
        return self.weights

    def _window(self, own: np.ndarray, aims: np.ndarray, state: np.ndarray) -> np.ndarray:
        """An update from one window (rows are streams); the state after it."""
        weights, (rows, span), hidden = self.weights, own.shape, state.shape[1]
        own = np.ascontiguousarray(own.T)
        embedded = weights["embed"][own]
        pre = _logits(embedded, weights["inner"], weights["bias"])
        goes_on = (own != self.end).astype(np.float32)[:, :, None]
        before, states, inner = (np.empty((span, rows, hidden), dtype=np.float32) for _ in range(3))
        candidate = np.empty((span, rows, hidden), dtype=np.float32)
        both = np.empty((span, rows, 2 * hidden), dtype=np.float32)
        for step in range(span):
            np.multiply(state, goes_on[step], out=before[step])
            state, both[step], candidate[step], inner[step] = gates(pre[step], before[step], weights["state"])
            states[step] = state
        grads, back = _output_gradients(weights, self.shape, states.reshape(-1, hidden), aims.T.ravel())
        back = back.reshape(span, rows, hidden)
        reset, update = both[:, :, :hidden], both[:, :, hidden:]
        by_candidate = (1 - update) * (1 - candidate * candidate)
        by_update = (before - candidate) * update * (1 - update)
        by_reset = inner * reset * (1 - reset)
        turned = np.empty((span, rows, 3 * hidden), dtype=np.float32)
        flow = np.zeros((rows, hidden), dtype=np.float32)
        across = np.ascontiguousarray(weights["state"].T)
        pre_back = np.empty_like(pre)
        for step in range(span - 1, -1, -1):
            flow += back[step]
            one, two = turned[step], pre_back[step]
            np.multiply(flow, by_candidate[step], out=two[:, 2 * hidden :])
            np.multiply(flow, by_update[step], out=one[:, hidden : 2 * hidden])
            np.multiply(two[:, 2 * hidden :], by_reset[step], out=one[:, :hidden])
            np.multiply(two[:, 2 * hidden :], reset[step], out=one[:, 2 * hidden :])
            flow *= update[step]
            flow += one @ across
            flow *= goes_on[step]
        pre_back[:, :, : 2 * hidden] = turned[:, :, : 2 * hidden]
        flat = pre_back.reshape(-1, 3 * hidden)
        grads["state"] = before.reshape(-1, hidden).T @ turned.reshape(-1, 3 * hidden)
        grads["inner"] = embedded.reshape(-1, hidden).T @ flat
        grads["bias"] = flat.sum(axis=0)
        self.turns += 1
        for name, mean in self.means.items():
            grad = np.clip(grads[name], -1, 1) if name in ("state", "inner", "bias") else grads[name]
            mean += 0.1 * (grad - mean)
            self.squares[name] += 0.01 * (grad**2 - self.squares[name])
            speed = RATE_DENSE * np.sqrt(1 - 0.99**self.turns) / (1 - 0.9**self.turns)
            weights[name] -= (speed * mean / (np.sqrt(self.squares[name]) + 1e-8)).astype(np.float32)
        _adjust_rows(weights["embed"], self.embed_squares, own.ravel(), flat @ weights["inner"].T)
        self.word_squares += (grads["word"] ** 2).mean(axis=1)
        weights["word"] -= RATE_ROWS * grads["word"] / np.sqrt(self.word_squares)[:, None]
        return state


def train(weights: Weights, shape: Shape, texts: list[np.ndarray], end: int) -> Weights:
    """The weights after one pass over the texts."""
    trainer = Trainer(weights, shape, end)
    if texts:
        trainer.segment(np.concatenate(texts))
    return trainer.finish()


def _output_gradients(weights: Weights, shape: Shape, states: np.ndarray, targets: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean negative log-likelihood for the output weights and the states."""
    count = len(targets)
    classes = shape.class_of(targets)
    logits = _logits(states, weights["class"], weights["class_bias"])
    shares = _shares(logits, _bounded(weights["class"].T, weights["class_bias"]))
    shares[np.arange(count), classes] -= 1
    back = shares @ weights["class"].T
    grads = {"class": states.T @ shares, "class_bias": shares.sum(axis=0)}
    grads["word"], grads["word_bias"] = np.zeros_like(weights["word"]), np.zeros_like(weights["word_bias"])
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(shape.classes + 1))
    order = order[: cuts[-1]]
    states, targets, by_word = states[order], targets[order], back[order]
    for number in range(shape.classes):
        rows, span = slice(cuts[number], cuts[number + 1]), shape.span(number)
        if rows.start < rows.stop and span.stop - span.start > 1:
            own, mine = weights["word"][span], states[rows]
            bias = weights["word_bias"][span]
            shares = _shares(_logits(mine, own.T, bias), _bounded(own, bias))
            shares[np.arange(len(mine)), targets[rows] - span.start] -= 1
            by_word[rows] += shares @ own
            grads["word_bias"][span] = shares.sum(axis=0)
            grads["word"][span] = shares.T @ mine
    back[order] = by_word
    back /= count
    return {name: grad / count for name, grad in grads.items()}, back


def _adjust_rows(table: np.ndarray, squares: np.ndarray, at: np.ndarray, grads: np.ndarray) -> None:
    """Adaptive step for the rows of a table that have a gradient; rows may repeat."""
    if not len(at):
        return
    order = np.argsort(at.astype(np.uint16) if len(table) <= 1 << 16 else at, kind="stable")
    sorted_ = at[order]
    starts = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1))
    rows, sums = sorted_[starts], np.add.reduceat(grads[order], starts, axis=0)
    squares[rows] += (sums**2).mean(axis=1)
    table[rows] -= RATE_ROWS * sums / np.sqrt(squares[rows])[:, None]
