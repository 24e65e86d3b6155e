"""Language-model scoring by a causal self-attention model (operator 7).

Texts become subword ids of a public byte-level BPE. A small causal
self-attention model, trained in numpy, predicts the class of the next
subword from up to ``2 * STRIDE`` earlier ones; the subword's share of its class, given the
subword before, is counted over all training texts. Scoring cuts a text into blocks of
``STRIDE`` ids; a window is a block and the one before it, attention is masked to earlier
positions, and only the block's own ids are scored, so overlapping windows
score every id once. The score is the log10 probability of all ids and one end id.

Beside it stands a unigram score over words, from exact counts of all training
texts. Words of a bounded head (the most frequent of a bounded sample) are
counted in tasks and looked up in a broadcast array; all other words are counted and
scored by a shuffle on the word. The head only saves shuffle: counts are exact for any head.

Subwords are described by the counts of their neighbours in all training texts: the vectors
that the attention sees are the main directions of these counts, the classes their clusters
(in ``GROUPS`` groups, so that the output layer predicts the group, then the class in it).
The weights are fitted to every window of every training text (the last one padded, the end
included): a row's hash puts it into one of ``steps`` disjoint slices, each in a folder of its own;
in a round every task makes Adam steps over its windows of one slice, and Spark hands the
tasks' weights to the driver, which averages them by windows. The loss of a window is that of
all its ids. What the driver holds is bounded by the vocabulary and the weights. Repeated texts count as often as they occur.

Defined results: a null text counts as empty (one end token); a null id is not
held out and is learned from; equal texts have equal scores; with nothing to
learn from, counts are zero and the model is that of its random start; base_score of an empty
training set uses N = V = 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.llm.bpe import encode_text, encoder, load_ranks, token_sizes
from adlens.llm.common import by_size, keep_memory, keep_table, ready
from adlens.llm.phrases import _gather, _spans, _word_hashes

STRIDE = 16
EVERY = 1   # every id of a window is predicted in training, as in scoring
WIDTH, HIDDEN = 16, 16
GROUPS, MEMBERS = 12, 11    # classes of subwords: so many groups of so many
LEFT, RIGHT = 512, 64       # buckets of a subword's neighbours, before and after it
OWN = 448                   # the most frequent subwords have buckets of their own
PRIOR = 4.0                 # weight of a subword's share of its class against its share after the subword before
LIMIT = np.float32(40)      # of attention scores, which are clipped to it in training and in scoring
BLOCKS = 256                # scored at a time in the attention: what they need fits a cache
TOGETHER = 4 * BLOCKS       # and in the output layer
BATCH = 512                 # windows of a training step
PART = 64                   # of them at a time in the attention: what they need fits a cache
_LOWER = bytes(10 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


# -- the model ---------------------------------------------------------------

class Model:
    """Class predictor over vectors of subwords; row ``vocab`` of ``vectors`` is the end, ``classes[id]`` is
    ``group * MEMBERS + member``, id ``vocab + 1`` is padding. What the attention predicts is added to ``groups`` and
    ``members``, log shares of the groups and of their members after a subword of each bucket (``left``)."""

    def __init__(self, vectors: np.ndarray, classes: np.ndarray, left: np.ndarray, groups: np.ndarray, members: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors, self.classes, self.left = vectors.astype(np.float32), classes, left
        self.groups, self.members = groups.astype(np.float32), members.astype(np.float32)
        self.to_groups, self.to_members = np.ascontiguousarray(self.groups.T), np.ascontiguousarray(self.members.transpose(1, 2, 0))
        group, member = np.divmod(np.append(classes, GROUPS * MEMBERS), MEMBERS)  # padding is in a group of its own
        self.group, self.member = group.astype(np.uint8), member.astype(np.uint8)
        self.wide = np.hstack([self.vectors, np.ones((len(vectors), 1), np.float32)])

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        self.p = {"q": init(WIDTH, WIDTH), "k": init(WIDTH, WIDTH), "v": init(WIDTH, WIDTH), "far": np.zeros(2 * STRIDE, np.float32),
                  "ho": init(WIDTH, HIDDEN), "hx": init(WIDTH, HIDDEN), "hb": np.zeros(HIDDEN, np.float32),
                  "out1": init(HIDDEN, GROUPS) / 8, "ob1": np.zeros(GROUPS, np.float32),
                  "out2": init(GROUPS, HIDDEN, MEMBERS) / 8, "ob2": np.zeros((GROUPS, MEMBERS), np.float32)}

    def sums(self, ids: np.ndarray, every: int = EVERY, shift: int = 0) -> tuple[float, dict[str, np.ndarray], int]:
        """Loss (negative log-likelihood of the classes that follow every ``every``-th place of windows of
        ``2 * STRIDE + 1`` ids) and gradients added up, and the number of ids predicted; padding has no part."""
        end, far = len(self.classes) - 1, self.p["far"].astype(np.float32)
        maps = self._maps()
        pre = np.empty((HIDDEN, len(ids) * len(range(0, 2 * STRIDE, every))), np.float32)
        at, following = np.empty((2, pre.shape[1]), ids.dtype)
        parts, done = [], 0
        for i in range(0, len(ids), PART):
            part = self._attend(ids[i:i + PART], every, shift + i, far, maps)
            parts.append((part, slice(done, done + len(part["own"]))))
            done += len(part["own"])
            own = parts[-1][1]
            at[own], following[own] = part["at"].ravel(), part["following"].ravel()
            np.add(maps["own"].T @ part["own"].T, part["context"], out=pre[:, own])
        group = _rows(self.group, following)
        order, runs = _by_group(group)  # padding is in a group of its own, the last
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        order = order[:runs[-1][1].stop if runs else 0]
        h = _columns(pre, order)
        np.maximum(h, 0, out=h)
        loss, dh, g = output_sums(self.p, h, runs, _rows(self.member, _rows(following, order)), self.to_groups, self.to_members,
                                  _rows(self.left, _rows(at, order)))
        sums = None
        np.multiply(dh, h > 0, out=pre[:, :len(order)])
        pre[:, len(order):] = 0
        dpre = _columns(pre, place)
        for part, own in parts:
            more = self._attend_back(part, dpre[:, own], maps)
            sums = more if sums is None else [x + y for x, y in zip(sums, more)]
        if sums is None:
            return 0.0, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        own, down, moved, back = sums
        p = self.p
        moved = moved[:WIDTH, :WIDTH] / np.sqrt(WIDTH)
        g |= {"hx": own[:WIDTH], "hb": own[WIDTH], "ho": p["v"].T @ down, "v": down @ p["ho"].T, "q": moved @ p["k"],
              "k": moved.T @ p["q"], "far": back}
        return loss, g, len(order)

    def _maps(self) -> dict[str, np.ndarray]:
        """The weights as maps from vectors with a 1 at their end."""
        p = self.p
        context = p["v"] @ p["ho"]
        maps = {"q": np.pad(p["q"] @ p["k"].T / np.sqrt(WIDTH), ((0, 1), (0, 1))), "context": np.pad(context, ((0, 1), (0, 0))),
                "own": np.vstack([p["hx"], p["hb"]]), "back": np.pad(context.T, ((0, 1), (0, 1)))}
        maps["back"][HIDDEN, WIDTH] = -1
        return {k: v.astype(np.float32) for k, v in maps.items()}

    def _attend(self, ids: np.ndarray, every: int, shift: int, far: np.ndarray, maps: dict[str, np.ndarray]) -> dict:
        """What the attention adds to the hidden layer of some windows (``context``, a column for each place), and what gradients need."""
        size, n = 2 * STRIDE, len(ids)
        x = _rows(self.wide, ids[:, :-1])  # padding takes the end's vector: it only follows what is predicted
        if every == 1:
            at, following, xt, back = ids[:, :-1], ids[:, 1:], x, np.arange(size)[:, None] - np.arange(size)
        else:
            targets = ((np.arange(n) + ids[:, 0] + shift) % every)[:, None] + np.arange(0, size, every)
            at, following = (np.take_along_axis(ids, targets + i, axis=1) for i in range(2))
            xt, back = x[np.arange(n)[:, None], targets], targets[:, :, None] - np.arange(size)
        own = xt.reshape(-1, WIDTH + 1)
        xc = np.ascontiguousarray(x.transpose(0, 2, 1))
        att = (own @ maps["q"]).reshape(xt.shape) @ xc
        within = _weights(att, far[np.maximum(back, 0)], back >= 0)
        both = (att @ x).reshape(-1, WIDTH + 1)  # weighted vectors, and the sum of the weights
        inverse = 1 / both[:, WIDTH]
        context = maps["context"].T @ both.T
        context *= inverse
        return {"at": at, "following": following, "x": x, "xc": xc, "own": own, "att": att, "within": within, "both": both, "back": back,
                "inverse": inverse, "context": context}

    def _attend_back(self, part: dict, dpre: np.ndarray, maps: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Sums over places that the gradients of the attention and of the hidden layer are made of."""
        scaled = np.empty((HIDDEN + 1, dpre.shape[1]), np.float32)
        np.multiply(dpre, part["inverse"], out=scaled[:HIDDEN])
        np.einsum("ij,ij->j", scaled[:HIDDEN], part["context"], out=scaled[HIDDEN])
        # of the weights: what their vectors would add less the mean of it, both from one product
        ds = (scaled.T @ maps["back"]).reshape(len(part["x"]), -1, WIDTH + 1) @ part["xc"]
        ds *= part["att"]
        if part["within"] is not None:
            ds *= part["within"]
        back = np.maximum(part["back"], 0).ravel()
        far = np.bincount(back, (ds.sum(axis=0) if part["back"].ndim == 2 else ds).ravel(), 2 * STRIDE)
        moved = part["own"].T @ (ds @ part["x"]).reshape(-1, WIDTH + 1)
        return [part["own"].T @ dpre.T, part["both"][:, :WIDTH].T @ scaled[:HIDDEN].T, moved, far]

    def fit(self, windows: Iterator[np.ndarray], rate: float, shift: int = 0) -> int:
        """Adam steps over batches of windows, in place; the windows that were seen."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        r = {k: np.zeros_like(v) for k, v in self.p.items()}
        done, seen = 0, 0

        def step(batch: np.ndarray) -> None:
            nonlocal done
            _, grads, n = self.sums(batch, shift=shift + done)
            if not n:
                return
            done += 1
            for k, g in grads.items():
                g = (g / n).astype(np.float32)
                m[k] += np.float32(0.1) * (g - m[k])
                r[k] += np.float32(0.01) * (g * g - r[k])
                self.p[k] = self.p[k] - np.float32(rate) * (m[k] / np.float32(1 - 0.9 ** done)) / (np.sqrt(r[k] / np.float32(1 - 0.99 ** done)) + np.float32(1e-8))

        rest = np.zeros((0, 2 * STRIDE + 1), np.int64)
        for more in windows:
            seen += len(more)
            rest = np.concatenate([rest, more]) if len(rest) else more
            while len(rest) >= BATCH:
                step(rest[:BATCH])
                rest = rest[BATCH:]
        if len(rest):
            step(rest)
        return seen

    def copy(self) -> Model:
        """Weights of its own, on the same vectors."""
        other = Model.__new__(Model)
        other.__dict__ = self.__dict__ | {"p": {k: v.copy() for k, v in self.p.items()}}
        return other

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        cuts = np.split(flat, np.cumsum([v.size for v in self.p.values()])[:-1])
        self.p = {k: c.reshape(v.shape).astype(np.float32) for (k, v), c in zip(self.p.items(), cuts)}

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring needs: ``x``, the vectors with a 1 at their end (padding is 0), the maps from them, and the classes' shares."""
        p = self.p
        i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None, :]
        maps = self._maps()
        return {"x": np.vstack([self.wide, np.zeros((1, WIDTH + 1), np.float32)]), "q": maps["q"], "context": maps["context"],
                "own": maps["own"], "out1": p["out1"], "out2": p["out2"], "left": np.append(self.left, 0),
                "group": self.group, "member": self.member,
                "groups": self.to_groups + p["ob1"][:, None], "members": self.to_members + p["ob2"][:, :, None],
                "far": p["far"][np.maximum(i - j, 0)], "mask": i >= j}


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=0, mode="clip")  # faster than an index; no place is outside


def _weights(s: np.ndarray, far: np.ndarray, seen: np.ndarray) -> np.ndarray | None:
    """Attention scores turned into weights in place: the exponentials of ``s + far``, clipped to ``LIMIT``, and 0 where nothing
    may be ``seen``. Returns where none was clipped (None: nowhere)."""
    if max(s.max(initial=0), -s.min(initial=0)) + np.abs(far).max(initial=0) < LIMIT:
        s += np.where(seen, far, np.float32(-np.inf))
        np.exp(s, out=s)
        return None
    s += far
    np.clip(s, -LIMIT, LIMIT, out=s)
    within = np.abs(s) < LIMIT
    np.exp(s, out=s)
    s *= seen
    return within


def _exp_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the largest value is taken off ``z``, in place; its exponentials, and their sum."""
    z -= z.max(axis=0)
    e = np.exp(z)
    return e, e.sum(axis=0)


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that puts equal groups together, and the run of each; ``GROUPS`` (padding) comes last and has no run."""
    order = np.argsort(group, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS)[:GROUPS])]).tolist()
    return order, [(i, slice(a, z)) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if a < z]


def _columns(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=1, mode="clip")


def output_sums(p: dict[str, np.ndarray], h: np.ndarray, runs: list[tuple[int, slice]], member: np.ndarray,
                to_groups: np.ndarray, to_members: np.ndarray, bucket: np.ndarray) -> tuple[float, np.ndarray, dict]:
    """Loss, gradient of the hidden layer (a column for each id, equal groups together), and gradients of the output layer."""
    z = p["out1"].T @ h
    z += _columns(to_groups + p["ob1"][:, None], bucket)
    dz, total = _exp_sums(z)
    loss = float(np.log(total).sum(dtype=np.float64))
    dz /= total
    for i, own in runs:
        loss -= float(z[i, own].sum(dtype=np.float64))
        dz[i, own] -= 1
    dh = p["out1"] @ dz
    g = {"out1": h @ dz.T, "ob1": dz.sum(axis=1), "out2": np.zeros_like(p["out2"]), "ob2": np.zeros_like(p["ob2"])}
    for i, own in runs:
        z = p["out2"][i].T @ h[:, own]
        z += _columns(to_members[i] + p["ob2"][i][:, None], bucket[own])
        dz, total = _exp_sums(z)
        at = _hits(member[own])
        loss += float(np.log(total).sum(dtype=np.float64)) - float(z.ravel()[at].sum(dtype=np.float64))
        dz /= total
        dz.ravel()[at] -= 1
        dh[:, own] += p["out2"][i] @ dz
        g["out2"][i], g["ob2"][i] = h[:, own] @ dz.T, dz.sum(axis=1)
    return loss, dh, g


def _hits(member: np.ndarray) -> np.ndarray:
    """Where the members lie in an array of a column for each."""
    return member.astype(np.int64) * len(member) + np.arange(len(member))


def _hidden(tables: dict[str, np.ndarray], blocks: np.ndarray, pad: int, out: np.ndarray) -> None:
    """The hidden layer of all blocks but the first, a column for each id."""
    x = _rows(tables["x"], blocks)
    near, own = np.concatenate([x[:-1], x[1:]], axis=1), x[1:].reshape(-1, WIDTH + 1)
    s = (own @ tables["q"]).reshape(-1, STRIDE, WIDTH + 1) @ np.ascontiguousarray(near.transpose(0, 2, 1))
    _weights(s, tables["far"], tables["mask"])
    s[blocks[:-1, 0] == pad, :, :STRIDE] = 0  # nothing comes before a text's first block
    both = (s @ near).reshape(-1, WIDTH + 1)  # weighted vectors, and the sum of the weights
    np.matmul(tables["context"].T, both.T, out=out)
    out /= both[:, WIDTH]
    out += tables["own"].T @ own.T


def class_log10(tables: dict[str, np.ndarray], classes: np.ndarray, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Per text, the sum of log10 P(class) over its ids and the end."""
    pad = end + 1
    sizes = np.array([-(-(len(d) + 1) // STRIDE) for d in docs])  # blocks of a text
    x = np.full((int(sizes.sum()) + len(docs)) * STRIDE, pad, dtype=np.int64)  # a block of padding before each text
    y = np.full(len(x), pad, dtype=np.int64)
    start = (np.cumsum(sizes + 1) - sizes) * STRIDE
    for d, s in zip(docs, start.tolist()):
        x[s], x[s + 1:s + 1 + len(d)] = end, d
        y[s:s + len(d)], y[s + len(d)] = d, end
    xb, yb = x.reshape(-1, STRIDE), y.reshape(-1, STRIDE)
    owner = np.repeat(np.arange(len(docs)), sizes + 1)
    total = np.zeros(len(docs))
    for at in range(1, len(xb), TOGETHER):
        own = slice(at, at + TOGETHER)
        ids, target = xb[own].ravel(), yb[own].ravel()
        order, runs = _by_group(_rows(tables["group"], target))
        real = order[:runs[-1][1].stop]
        h = np.empty((HIDDEN, len(ids)), np.float32)
        for i in range(0, len(ids) // STRIDE, BLOCKS):
            _hidden(tables, xb[at + i - 1:min(at + i + BLOCKS, own.stop)], pad, h[:, i * STRIDE:(i + BLOCKS) * STRIDE])
        h = _columns(h, real)
        np.maximum(h, 0, out=h)
        bucket, member = _rows(tables["left"], _rows(ids, real)), _rows(tables["member"], _rows(target, real))
        z = tables["out1"].T @ h
        z += _columns(tables["groups"], bucket)
        hit = -np.log(_exp_sums(z)[1])
        for i, rows in runs:
            hit[rows] += z[i, rows]
            y = tables["out2"][i].T @ h[:, rows]
            y += _columns(tables["members"][i], bucket[rows])
            sums = _exp_sums(y)[1]
            hit[rows] += y.ravel()[_hits(member[rows])] - np.log(sums)
        total += np.bincount(_rows(np.repeat(owner[own], STRIDE), real), hit, len(docs))
    return total / np.log(10)


def describe(neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and classes of subwords from ``neighbours`` (a row of counts for each subword and the end): the main
    directions of the rows, and k-means clusters, put into groups along the first direction. Unseen subwords have the
    vector 0 and are spread over the classes."""
    n = GROUPS * MEMBERS
    vectors, classes = np.zeros((len(neighbours), WIDTH)), np.arange(len(neighbours)) % n
    weight = neighbours.sum(axis=1)
    seen = np.flatnonzero(weight)
    if not len(seen):
        return vectors, classes
    weight = weight[seen].astype(np.float64)
    keep = OWN // 4  # the buckets of the most frequent subwords; the others are folded, as they say little one by one
    mat = np.concatenate([neighbours[seen][:, :keep], neighbours[seen][:, LEFT:]], axis=1)
    folded = np.zeros((len(seen), 32), neighbours.dtype)
    for i in range(keep, LEFT):
        folded[:, i % 32] += neighbours[seen, i]
    mat = np.sqrt(np.concatenate([mat, folded], axis=1).astype(np.float32))
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    mean = (weight @ mat / weight.sum()).astype(np.float32)
    spread = (mat - mean).T @ ((mat - mean) * np.sqrt(weight)[:, None].astype(np.float32))
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :WIDTH]
    found = (mat - mean) @ axes
    found /= np.maximum(np.sqrt((weight @ found ** 2) / weight.sum()), 1e-9)
    vectors[seen] = found
    centres = mat[np.argsort(-weight, kind="stable")[:n]]
    own = np.zeros(len(seen), dtype=np.int64)
    for _ in range(10):
        own = (mat @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, mat * np.sqrt(weight)[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-6), centres)
    place = np.argsort(np.argsort((centres - mean) @ axes[:, 0], kind="stable"))
    classes[seen] = place[own]
    return vectors, classes


# -- the jobs ----------------------------------------------------------------

def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts (A-Z lower-cased) in order, and the text of each."""
    blob = b"\n".join(texts).translate(_LOWER)
    data = np.frombuffer(blob, dtype=np.uint8)
    starts, ends = _spans(data)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return _word_hashes(data, starts, ends).view(np.int64), np.searchsorted(begins, starts, side="right") - 1


def _head(docs: DataFrame, rows: int, sample_docs: int, head_words: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of a sample of about ``sample_docs`` texts."""

    def run(batches):
        for b in by_size(batches, "text"):
            h, n = np.unique(_words([t or b"" for t in b.column(0).to_pylist()])[0], return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n, pa.int64())], names=["h", "n"])

    chosen = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(rows, 1))) < sample_docs).select("text")
    top = chosen.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(head_words)
    return np.sort(top.select("h").toArrow().column("h").to_numpy())


def _offsets(of: np.ndarray, rows: int, size: int = 1) -> pa.Buffer:
    """Offsets of the rows' runs in an array whose entries belong to the ascending rows ``of``."""
    return pa.py_buffer((np.searchsorted(of, np.arange(rows + 1)) * size).astype(np.int32))


def _places(head: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Looks hashes up in the sorted ``head``: the places of the first hash that is no smaller, and whether it is the same. The
    upper bits say where to begin; from there it is a step or two, where a search would be many."""
    bits = max(1, int(len(head) * 8 - 1).bit_length())
    upper = (lambda h: ((h >> (64 - bits)) + (1 << (bits - 1))).astype(np.int32))
    begin = np.searchsorted(upper(head), np.arange(1 << bits)).astype(np.int32)
    last = np.iinfo(np.int64).max
    ahead = np.append(head, last)  # the largest hash ends every walk

    def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _rows(begin, upper(h))
        found = _rows(ahead, at)
        behind = np.flatnonzero(found < h)
        while len(behind):
            at[behind] += 1
            found[behind] = _rows(ahead, at[behind])
            behind = behind[found[behind] < h[behind]]
        return at, (found == h) & (at < len(head))

    return look


class _Pieces:
    """The ids of texts. A text is cut before each blank or line feed that follows a letter, digit or mark of ASCII or any
    character of U+00C0 to U+07FF: none of these is white space, and no match of the pattern runs from one into white space, so a
    new match starts there (see ``bpe``) and a piece has the same ids anywhere. The first ``most`` pieces that are met are encoded
    once and looked up by their 64-bit hashes; what is between them is encoded text by text."""

    def __init__(self, ranks: bytes, pattern: str, most: int = 1 << 16, longest: int = 64):
        self.enc, self.sizes, self.most, self.longest = encoder(ranks, pattern), token_sizes(ranks), most, longest
        self.values = np.zeros(0, "<u2" if len(self.sizes) <= 1 << 16 else "<u4")
        self.hashes, self.begin, self.size = np.zeros((3, 0), np.int64)
        self.look = _places(self.hashes)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each end."""
        data, length = np.frombuffer(b"\0".join(texts), np.uint8), np.array([len(t) for t in texts])
        begins = np.cumsum(length + 1) - length - 1
        solid = (data > 32) & (data < 127)
        solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF) & (data[1:] >= 0x80) & (data[1:] <= 0xBF)
        safe = np.flatnonzero(((data[1:] == 32) | (data[1:] == 10)) & solid[:-1]) + 1
        first = np.searchsorted(safe, begins)
        start = np.insert(safe, first, begins)
        first += np.arange(len(texts))
        after = np.append(first[1:], len(start))
        end = np.append(start[1:], len(data) + 1)
        end[after - 1] -= 1
        plain = (end - start > 1) & (end - start <= self.longest)
        plain[first] = False
        plain = np.flatnonzero(plain)
        plain = plain[solid[end[plain] - 1]]
        h = _word_hashes(data, start[plain], end[plain]).view(np.int64)
        at, known = self.look(h)
        try:
            if len(self.hashes) < self.most and not known.all():
                new, where = np.unique(h[~known], return_index=True)
                where = plain[~known][where]
                self._learn(new, *_gather(data, start[where], (end - start)[where]))
                at, known = self.look(h)
            rest = np.ones(len(start), bool)
            rest[plain[known]] = False
            between, offsets = _gather(data, start[rest], (end - start)[rest])
            cuts = np.append(offsets[:-1][(np.cumsum(rest) - 1)[first]], offsets[-1]).tolist()  # a text's first piece is never looked up
            between = between.tobytes()
            found = np.concatenate([encode_text(self.enc, between[a:z].decode("utf-8")) for a, z in zip(cuts[:-1], cuts[1:])])
        except UnicodeDecodeError:
            whole = [encode_text(self.enc, t.decode("utf-8", "replace")) for t in texts]
            return np.concatenate(whole).astype(self.values.dtype), np.cumsum([len(x) for x in whole])
        begin, size = np.empty((2, len(start)), np.int64)
        begin[plain[known]], size[plain[known]] = self.begin[at[known]], self.size[at[known]]
        stops = np.searchsorted(np.cumsum(self.sizes[found]), offsets, side="right")
        begin[rest], size[rest] = stops[:-1] + len(self.values), np.diff(stops)
        upto = np.cumsum(size)
        values = np.concatenate([self.values, found.astype(self.values.dtype)])
        return values[np.repeat(begin - upto + size, size) + np.arange(upto[-1])], upto[after - 1]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """Keeps the ids of pieces, which are encoded together and told apart by the bytes of their ids."""
        ids = encode_text(self.enc, data.tobytes().decode("utf-8"))
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), offsets, side="right")
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.begin = np.concatenate([self.begin, stops[:-1] + len(self.values)])[order]
        self.size = np.concatenate([self.size, np.diff(stops)])[order]
        self.values = np.concatenate([self.values, ids.astype(self.values.dtype)])
        self.look = _places(self.hashes)


def _prepared(docs: DataFrame, head: np.ndarray, ranks: bytes, pattern: str, slices: int) -> DataFrame:
    """One stored row per row of ``docs``: subword ids, places of its words in the head, counts of the others, and the
    slice of the training rows (-1: held out), which is a folder."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((head, ranks))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        head, ranks = shared.value
        pieces, place = _Pieces(ranks, pattern), _places(head)
        for b in by_size(batches, "text", 1 << 19):  # so that the arrays of its words fit a cache
            texts, n = [t or b"" for t in b.column("text").to_pylist()], b.num_rows
            h, of = _words(texts)
            at, known = place(h)
            other, other_of = h[~known], of[~known]
            order = np.lexsort((other, other_of))
            other, other_of = other[order], other_of[order]
            first = np.flatnonzero(np.r_[True, (other[1:] != other[:-1]) | (other_of[1:] != other_of[:-1])][:len(other)])
            count = np.diff(np.r_[first, len(other)])
            places, others, other_n = (pa.Array.from_buffers(pa.binary(), n, [None, _offsets(owner, n, x.itemsize), pa.py_buffer(x)]) for owner, x in (
                (of[known], at[known].astype("<i4")), (other_of[first], other[first].astype("<i8")), (other_of[first], count.astype("<i4"))))
            ids, stops = pieces.ids(texts)
            ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, stops * ids.itemsize].astype(np.int32)), pa.py_buffer(ids)])
            tid = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
            yield pa.record_batch([b.column("id"), b.column("held_out"), pa.array(tid, pa.int64()),
                                   pa.array(np.bincount(of, minlength=n)), ids, places, others, other_n],
                                  names=["id", "held_out", "tid", "n_words", "ids", "places", "others", "other_n"])

    rows = docs.mapInArrow(run, f"id {id_type}, held_out boolean, tid long, n_words long, ids binary, "
                                "places binary, others binary, other_n binary")
    drawn = F.pmod(F.xxhash64("id", "tid", F.lit(5)), F.lit(max(slices, 1))).cast("int")
    return keep_table(rows.withColumn("slice", F.when(F.col("held_out"), -1).otherwise(drawn)), "lm-prepared", ["slice"])


def _few(df: DataFrame, a_core: int = 2) -> DataFrame:
    """In a few tasks a core, each of which gives one set of sums."""
    return df.coalesce(a_core * df.sparkSession.sparkContext.defaultParallelism)


def _sparse(kind: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(n)
    for i in range(0, len(at), 1 << 16):
        part = at[i:i + (1 << 16)]
        yield pa.record_batch([pa.array(np.full(len(part), kind), pa.int32()), pa.array(part), pa.array(n[part].astype(np.int64))],
                              names=["kind", "at", "n"])


def _dense(found: DataFrame, sizes: list[int], kind_of=np.int64) -> list[np.ndarray]:
    table = found.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as the sizes say
    kind, at, n = (table.column(c).to_numpy() for c in ("kind", "at", "n"))
    out = [np.zeros(size, kind_of) for size in sizes]
    for k, a in enumerate(out):
        a[at[kind == k]] = n[kind == k]
    return out


def _counts(prepared: DataFrame, head_size: int, vocab: int, ids_type: str) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of the head's words, and of all subwords (the end at ``vocab``: the number of training texts)."""

    def run(batches):
        words, subs = np.zeros(head_size, np.int64), np.zeros(vocab + 1, np.int64)
        for b in by_size(batches, "ids", 1 << 20, 4096):
            ids, places = (b"".join(b.column(i).to_pylist()) for i in range(2))
            if head_size:
                words += np.bincount(np.frombuffer(places, "<i4"), minlength=head_size)
            subs += np.bincount(np.frombuffer(ids, ids_type), minlength=vocab + 1)
            subs[vocab] += b.num_rows
        for kind, n in enumerate((words, subs)):
            yield from _sparse(kind, n)

    found = _few(prepared.where("not held_out").select("ids", "places")).mapInArrow(run, "kind int, at long, n long")
    return tuple(_dense(found, [head_size, vocab + 1]))


def buckets(subs: np.ndarray, size: int) -> np.ndarray:
    """The bucket of every subword as a neighbour: the most frequent have their own, the others share the rest."""
    own = min(OWN, size * 7 // 8)
    rank = np.empty(len(subs), np.int64)
    rank[np.argsort(-subs, kind="stable")] = np.arange(len(subs))
    return np.where(rank < own, rank, own + np.arange(len(subs)) * 7919 % (size - own))


def _neighbours(prepared: DataFrame, left: np.ndarray, right: np.ndarray, ids_type: str) -> np.ndarray:
    """Training counts of each subword's neighbours (one row each, the end's last) by bucket: those before it,
    then those after it; beside a text's ids stands its end."""
    vocab, wide = len(left) - 1, LEFT + RIGHT

    def run(batches):
        near = np.zeros((vocab + 1) * wide, np.int32)
        for b in by_size(batches, "ids", 1 << 22, 16384):
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), ids_type).astype(np.int64)
            ends = np.cumsum(pa.compute.binary_length(b.column(0)).to_numpy()) // np.dtype(ids_type).itemsize
            before = np.insert(ids, np.r_[0, ends[:-1]], vocab)  # of a text: the end, its ids; beside them its ids, the end
            after = np.insert(ids, ends, vocab)
            pairs = np.sort((before * (vocab + 1) + after).astype(np.uint32 if vocab < 1 << 16 else np.int64))
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            n = np.diff(np.r_[first, len(pairs)]).astype(np.int32)
            before, after = np.divmod(pairs[first].astype(np.int64), vocab + 1)
            for keys in (after * wide + left[before], before * wide + LEFT + right[after]):
                np.add.at(near, keys, n)
        yield from _sparse(0, near)

    found = _few(prepared.where("not held_out").select("ids"), 1).mapInArrow(run, "kind int, at long, n long")
    return _dense(found, [(vocab + 1) * wide], np.float32)[0].reshape(vocab + 1, wide)


def class_shares(near: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the groups, and of the members of each group, after a subword of every bucket."""
    n = np.zeros((GROUPS * MEMBERS, LEFT))
    np.add.at(n, classes, near[:, :LEFT].astype(np.float64))
    n = n.T.reshape(LEFT, GROUPS, MEMBERS)
    members = n.sum(axis=0) + 0.1
    n += PRIOR * members / members.sum()
    groups = n.sum(axis=2)
    members = n + PRIOR * (members / members.sum(axis=1, keepdims=True))
    return np.log(groups / groups.sum(axis=1, keepdims=True)), np.log(members / members.sum(axis=2, keepdims=True))


class Shares:
    """log10 of each subword's share of its class, for every bucket of the subword before it: shares add up to 1 over the
    subwords of a class. Made of the counts ``n`` that are not 0 (``at``: places in a row for each subword of a column for each
    bucket), which are few: only what they add to the share of a subword that was not counted there is kept."""

    def __init__(self, at: np.ndarray, n: np.ndarray, subs: np.ndarray, classes: np.ndarray):
        size = GROUPS * MEMBERS
        plain = (subs + 0.1) / (np.bincount(classes, subs, size) + 0.1 * np.bincount(classes, minlength=size))[classes]
        ids, bucket = np.divmod(at, LEFT)
        in_class = np.bincount(classes[ids] * LEFT + bucket, n, size * LEFT)
        self.classes, self.plain, self.in_class = classes, np.log10(PRIOR * plain), np.log10(in_class + PRIOR)
        self.more = np.zeros(len(subs) * LEFT, np.float32)  # memory is only taken where counts are
        self.more[at] = np.log10(1 + n / (PRIOR * plain[ids]))

    def of(self, ids: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return _rows(self.plain, ids) - _rows(self.in_class, _rows(self.classes, ids) * LEFT + bucket) + _rows(self.more, ids * LEFT + bucket)


def shares(near: np.ndarray, subs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shares of all subwords after every bucket."""
    counted = near[:, :LEFT].ravel()
    at = np.flatnonzero(counted)
    ids, bucket = np.indices((len(subs), LEFT))
    return Shares(at, counted[at], subs, classes).of(ids, bucket)


_TABLE: list = []  # of a worker process: what was broadcast last, and the shares made of it


def _share_table(sent: tuple) -> Shares:
    if not _TABLE or _TABLE[0] is not sent:
        _TABLE[:] = [sent, Shares(*sent)]
    return _TABLE[1]


def text_windows(ids: np.ndarray, end: int) -> np.ndarray:
    """The windows of a text between its two ends: every id, and the end, follows once; the last window is padded."""
    size = 2 * STRIDE
    seq = np.full(-(-(len(ids) + 1) // size) * size + 1, end + 1, dtype=np.int32)
    seq[0], seq[1:len(ids) + 1], seq[len(ids) + 1] = end, ids, end
    return np.lib.stride_tricks.sliding_window_view(seq, size + 1)[::size]


def _round(prepared: DataFrame, model: Model, piece: int, rate: float, ids_type: str) -> int:
    """One round over all windows of a slice: each task fits the weights to its windows, and the tasks' weights are
    averaged (a row of weights per task comes to the driver). Returns the number of windows."""
    end = len(model.classes) - 1
    shared = prepared.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value.copy()
        keep_memory()

        def windows():
            for b in by_size(batches, "ids", 1 << 19):
                texts = [text_windows(np.frombuffer(x.as_py(), ids_type), end) for x in b.column(0)]
                yield np.concatenate(texts)

        n = model.fit(windows(), rate, piece)
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([model.flat().astype("<f8").tobytes()], pa.binary())], names=["n", "weights"])

    found = _few(prepared.where(F.col("slice") == piece).select("ids")).mapInArrow(run, "n long, weights binary").collect()
    shared.destroy()
    total = sum(r.n for r in found)
    if total:
        model.put(sum(np.frombuffer(r.weights, "<f8") * (r.n / total) for r in sorted(found, key=lambda r: (r.n, bytes(r.weights)))))
    return total


def _other_words(prepared: DataFrame) -> DataFrame:
    """``tid, logs, known, distinct``: of the words outside the head, per distinct text the sum of
    log10(c + 0.1) and the known tokens; ``distinct`` adds up to the number of known words, ``tokens`` to their training count."""

    def run(batches):
        for b in by_size(batches, "others", 1 << 20):
            h, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind) for c, kind in (("others", "<i8"), ("other_n", "<i4")))
            of = np.repeat(np.arange(b.num_rows), pa.compute.binary_length(b.column("others")).to_numpy() // 8)
            tid, rows = (b.column(c).to_numpy()[of] for c in ("tid", "rows"))
            yield pa.record_batch([pa.array(h), pa.array(tid), pa.array(n, pa.int64()), pa.array(n * rows)], names=["h", "tid", "n", "train"])

    texts = prepared.groupBy("tid").agg(F.first("others").alias("others"), F.first("other_n").alias("other_n"),
                                        F.sum((~F.col("held_out")).cast("long")).alias("rows"))
    by_word = Window.partitionBy("h")
    counted = (texts.mapInArrow(run, "h long, tid long, n long, train long")
               .withColumn("c", F.sum("train").over(by_word)).withColumn("first", F.min("tid").over(by_word) == F.col("tid")))
    known = F.col("c") > 0
    return keep_table(counted.groupBy("tid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("logs"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.sum((known & F.col("first")).cast("long")).alias("distinct"), F.sum("train").alias("tokens")), "lm-others")


def score_texts(docs: DataFrame, held_out: Column, *, rank_path: str, pattern: str, id_col: str = "doc_id",
                text_col: str = "text", head_words: int = 1 << 17, sample_docs: int = 8192,
                steps: int = 8, rate: float = 0.01) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row;
    rows with ``held_out`` are not learned from. ``sample_docs`` texts choose the head of words only.
    ``steps`` rounds go once over all training windows."""
    d = ready(docs).select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                    F.col(text_col).cast("binary").alias("text"))
    ranks = load_ranks(rank_path)
    vocab = encoder(ranks, pattern).max_token_value + 1
    ids_type = "<u2" if vocab <= 1 << 16 else "<u4"
    head = _head(d, d.count(), sample_docs, head_words)
    prepared = _prepared(d, head, ranks, pattern, steps)
    words, subs = _counts(prepared, len(head), vocab, ids_type)
    texts = int(subs[vocab])
    others = _other_words(prepared)
    tail = others.agg(F.sum("distinct"), F.sum("tokens")).first()
    total = int(words.sum()) + texts + int(tail[1] or 0)
    distinct = int((words > 0).sum()) + (texts > 0) + int(tail[0] or 0)
    left = buckets(subs, LEFT)
    near = _neighbours(prepared, left, buckets(subs, RIGHT), ids_type)
    vectors, classes = describe(near)
    model = Model(vectors, classes, left, *class_shares(near, classes))
    for i in range(steps if texts else 0):
        _round(prepared, model, i, rate * (1 - i / steps), ids_type)
    counted = near[:, :LEFT].ravel()
    at = np.flatnonzero(counted).astype(np.int32)
    sent = (at, counted[at], subs, classes)
    shared = d.sparkSession.sparkContext.broadcast((model.tables(), sent, np.log10(words + 0.1), words > 0))
    end_log, norm = float(np.log10(texts + 0.1)), float(np.log10(total + 0.1 * (distinct + 1)))
    id_type = d.schema["id"].dataType.simpleString()

    def run(batches):
        tables, sent, logs, known = shared.value
        classes, share = sent[3], _share_table(sent)
        keep_memory()
        for b in by_size(batches, "ids", 1 << 20):
            ids = [np.frombuffer(x, ids_type).astype(np.int64) for x in b.column("ids").to_pylist()]
            score = class_log10(tables, classes, ids, vocab)
            ends = np.cumsum([len(x) + 1 for x in ids])
            seq = np.concatenate([part for x in ids for part in (x, [vocab])])
            before = np.r_[vocab, seq[:-1]]  # the end of the text before stands for a text's beginning
            at = np.frombuffer(b"".join(b.column("places").to_pylist()), "<i4")
            cuts = np.cumsum(pa.compute.binary_length(b.column("places")).to_numpy()) // 4

            def summed(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
                upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
                return np.diff(upto[np.r_[0, stops]])

            score += summed(share.of(seq, tables["left"][before]), ends)
            base, n_known = summed(logs[at], cuts) + end_log, summed(known[at].astype(np.int64), cuts) + (texts > 0)
            yield pa.record_batch([b.column("id"), b.column("held_out"), b.column("tid"),
                                   pa.array(b.column("n_words").to_numpy() + 1), pa.array(n_known), pa.array(base), pa.array(score)],
                                  names=["id", "held_out", "tid", "n_tokens", "n_known", "base", "score"])

    scored = prepared.select("id", "held_out", "tid", "n_words", "ids", "places").mapInArrow(
        run, f"id {id_type}, held_out boolean, tid long, n_tokens long, n_known long, base double, score double")
    return scored.join(others.select("tid", "logs", "known"), "tid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
