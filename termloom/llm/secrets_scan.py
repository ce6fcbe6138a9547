"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Base findings come from three patterns. Candidates are all runs of 16 or more characters of ``[A-Za-z0-9+/_=-]``; each is judged with the text
around it by a small convolutional network in numpy: character embeddings with a channel that tells candidate from context, one
convolution, maximum and mean over the window, a logistic output. The network sees 40 characters of a candidate at a time; of longer ones windows at every
``STRIDE`` characters and the last one are judged, each with the candidate's context, and the largest probability counts. It is trained on labelled findings: by default a seeded, bounded set of
``FINDINGS`` made-up ones (keys, tokens, digests, encoded blobs against words, paths, identifiers, dates, links), or findings that the caller passes. A third is held back: on it
the outputs are calibrated (Platt) and the threshold is the highest one that still recalls ``RECALL`` of the true findings. The default network's
threshold also recalls as many of the ``LONG`` made-up longer runs, half of them with a secret somewhere in them, by the largest probability. Findings of the
network are added under the kind ``model`` unless base findings cover them whole; base findings stay, and spans may overlap.

Defined cases: null counts as empty text without findings; repeated rows are scanned alike; other columns are not read by the operator and passed
through by the stage; an empty table gives an empty result. A very long text is scanned whole. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import _vec as V
from ._spark import batch, table

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ASSIGNS = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
LEFT, INSIDE, RIGHT = 24, 40, 8
WINDOW = LEFT + INSIDE + RIGHT
#: Any 30 characters of a candidate lie within one of its windows.
STRIDE = 10
#: Windows that are judged at a time.
CHUNK = 4096
FINDINGS, LONG, RECALL = 4500, 900, 0.98
_CODES, _DIM, _WIDTH, _FILTERS = 100, 8, 5, 24

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for c in CANDIDATE.finditer(text):  # both kinds of 16 and more characters lie within candidates
        a, b = c.span()
        if text.find("AKIA", a, b) >= 0:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        if b - a >= 32:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    return sorted(out)


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin; together they hold all of it."""
    last = max(start, end - INSIDE)
    return [*range(start, last, STRIDE), last]


def window_codes(text: str, start: int, end: int, at: int | None = None) -> np.ndarray:
    """Codes of the window: context, the candidate's characters from ``at`` on (its first ones), context after it; 0 where there is nothing."""
    out = np.zeros(WINDOW, np.int64)
    inside = start if at is None else at
    stop = min(end, inside + INSIDE)
    for to, part in ((LEFT - len(text[max(0, start - LEFT) : start]), text[max(0, start - LEFT) : start]), (LEFT, text[inside:stop]), (LEFT + INSIDE, text[end : end + RIGHT])):
        if part:
            c = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64)
            out[to : to + len(c)] = np.where((c > 32) & (c < 127), c - 31, np.where(c <= 32, 97, 98))
    return out


def labelled_findings(n: int = FINDINGS, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Made-up labelled findings: (window codes, labels)."""
    r = random.Random(seed)
    syllables = "the and ing ed er on re at en nd ti es or te of is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur schaft ung keit lich ein ver ver eau sch pf tz ch ge be zu au ie der gam bo jo os ment que ción ado mente".split()
    keys = "password passwd secret token api_key apikey auth bearer credential private_key client_secret access_key pwd signing_key webhook session".split()

    def word(low=1, high=4):
        return "".join(r.choice(syllables) for _ in range(r.randint(low, high)))

    def prose(k):
        return " ".join(word() for _ in range(k))

    def draw(letters, low, high):
        return "".join(r.choice(letters) for _ in range(r.randint(low, high)))

    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    secret = [
        lambda: draw(digits + "abcdef", 32, 64),
        lambda: draw(upper + lower + digits + "+/", 20, 60) + r.choice(["", "=", "=="]),
        lambda: "AKIA" + draw(upper + digits, 12, 20),
        lambda: r.choice(["sk_live_", "ghp_", "xoxb-", "AIza", "glpat-"]) + draw(upper + lower + digits, 20, 40),
        lambda: draw(upper + lower + digits + "-_", 24, 48),
    ]
    plain = [
        lambda: word(5, 12),
        lambda: word(5, 9).capitalize(),
        lambda: "-".join(word(1, 3) for _ in range(r.randint(3, 6))),
        lambda: "_".join(word(1, 3) for _ in range(r.randint(3, 6))),
        lambda: "/".join(word(1, 3) for _ in range(r.randint(3, 6))),
        lambda: "/" + "/".join([*(word(1, 2) for _ in range(3)), str(r.randrange(10000))]),
        lambda: f"20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}-" + word(2, 4),
        lambda: r.choice("=-_+") * r.randint(16, 60),
        lambda: draw(digits, 16, 20),
        lambda: word(4, 8).upper(),
        lambda: "".join(word(1, 2).capitalize() for _ in range(r.randint(4, 7))),
        lambda: word(4, 8) + str(r.randrange(1000)),
        lambda: draw(lower, 16, 30),
        lambda: word(6, 12),
    ]
    codes, labels = [], []
    for i in range(n):
        good = i % 2
        value = r.choice(secret if good else plain)()
        if len(value) < 16:
            value += value
        if good and r.random() < 0.7 or not good and r.random() < 0.15:
            before = prose(r.randint(0, 4)) + " " + r.choice(keys) + r.choice([" = \"", "=", ": ", "': '", " "])
        else:
            before = prose(r.randint(0, 5)) + r.choice([" ", " \"", "\n", " (", ": ", "| "])
        text = before + value + r.choice(["", "\"", " ", ". ", ", ", "\n"]) + prose(2)
        codes.append(window_codes(text, len(before), len(before) + len(value)))
        labels.append(good)
    return np.array(codes), np.array(labels, np.float64)


def long_findings(n: int = LONG, seed: int = 9) -> list[tuple[str, int, int, int, int]]:
    """Made-up candidates of more than ``INSIDE`` characters, every other one with a secret: (text, start, end, secret's start, secret's end)."""
    r = random.Random(seed)
    words = "config production services payment gateway credentials release backup archive user account data static images module include source local share report index schema version storage public internal common client server".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def syllables():
        return "".join(r.choice("ba ce di fo gu ka le mi no pu ra se ti vo wen sch ung ter lin tor".split()) for _ in range(r.randint(1, 4)))

    def run(least):
        if r.random() < 0.1:
            return r.choice("=-_+") * r.randint(least, least + 60)
        mark, out = r.choice("/_-/"), ""
        while len(out) < least:
            part = r.choice(words) if r.random() < 0.6 else syllables() if r.random() < 0.8 else str(r.randrange(10000))
            out += part.capitalize() * (r.random() < 0.2) or part
            out += mark
        return out

    out = []
    for i in range(n):
        head, secret, tail = run(r.choice([41, 60, 90, 140])), "", ""
        if i % 2:
            head = run(r.choice([1, 20, 41, 60, 90])) + r.choice(["", "=", "key=", "/"])
            kind = r.choice([letters, letters + "+/", letters + "-_", "0123456789abcdef"])
            secret = "".join(r.choice(kind) for _ in range(r.randint(32 if len(kind) == 16 else 24, 60)))
            tail = "/" + run(r.choice([1, 20, 60])) if r.random() < 0.4 or len(head) + len(secret) <= INSIDE else ""
        before = " ".join(syllables() for _ in range(r.randint(0, 4))) + r.choice([" ", "\n", ' "', " (", ": "])
        value = head + secret + tail
        at = len(before) + len(head)
        out.append((before + value + r.choice(["", " ", '"', ". ", "\n"]) + syllables(), len(before), len(before) + len(value), at, at + len(secret)))
    return out


@dataclass(frozen=True)
class Network:
    embedding: np.ndarray  # (codes, dim)
    kernel: np.ndarray  # (width * (dim + 1), filters)
    bias: np.ndarray
    out: np.ndarray  # (2 * filters + 1,)
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def features(self, codes: np.ndarray):
        x = np.concatenate([self.embedding[codes], np.broadcast_to(_MARK, (len(codes), WINDOW, 1))], 2)
        x[codes == 0] = 0
        cols = np.lib.stride_tricks.sliding_window_view(x, _WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(codes), WINDOW - _WIDTH + 1, -1)
        h = cols @ self.kernel + self.bias
        np.maximum(h, 0, out=h)
        return x, cols, h, np.concatenate([h.max(1), h.mean(1), np.ones((len(codes), 1), np.float32)], 1)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(codes[a : a + 512])[3] @ self.out for a in range(0, len(codes), 512)] or [np.zeros(0)])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(codes) + b, -500, 500)))


_MARK = np.zeros((1, WINDOW, 1), np.float32)
_MARK[0, LEFT : LEFT + INSIDE] = 1


def fit(codes: np.ndarray, labels: np.ndarray, epochs: int = 5, rate: float = 3e-3, recall: float = RECALL, seed: int = 4) -> Network:
    """Train on two thirds (Adam, batches of 64), calibrate and set the threshold on the rest."""
    r = np.random.Generator(np.random.PCG64(seed))
    order = r.permutation(len(codes))
    rest, own = order[: len(order) // 3], order[len(order) // 3 :]
    p = [
        r.normal(0, 0.3, (_CODES, _DIM)).astype(np.float32),
        r.normal(0, 0.15, (_WIDTH * (_DIM + 1), _FILTERS)).astype(np.float32),
        np.zeros(_FILTERS, np.float32),
        r.normal(0, 0.1, 2 * _FILTERS + 1).astype(np.float32),
    ]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step, span = 0, WINDOW - _WIDTH + 1
    for _ in range(epochs):
        r.shuffle(own)
        for a in range(0, len(own), 64):
            i = own[a : a + 64]
            c = codes[i]
            net = Network(*p)
            _, cols, h, f = net.features(c)
            d = (1 / (1 + np.exp(-(f @ p[3]))) - labels[i]).astype(np.float32) / len(i)
            df = d[:, None] * p[3]
            dh = np.repeat(df[:, None, _FILTERS : 2 * _FILTERS] / span, span, 1)
            best = h.argmax(1)
            np.add.at(dh, (np.arange(len(i))[:, None], best, np.arange(_FILTERS)[None]), df[:, :_FILTERS])
            dh[h <= 0] = 0
            flat = dh.reshape(-1, _FILTERS)
            dx = np.zeros((len(i), WINDOW, _DIM + 1), np.float32)
            dcols = (flat @ p[1].T).reshape(len(i), span, _WIDTH, _DIM + 1)
            for w in range(_WIDTH):
                dx[:, w : w + span] += dcols[:, :, w]
            dx[c == 0] = 0
            de = np.zeros_like(p[0])
            np.add.at(de, c.ravel(), dx[:, :, :_DIM].reshape(-1, _DIM))
            step += 1
            for k, g in enumerate((de, cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0), f.T @ d)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(*p)
    z, y = net.logits(codes[rest]).astype(np.float64), labels[rest]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * z).sum() + 0.01 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    net = Network(*p, platt=(float(a), float(b)))
    q = np.sort(net.probabilities(codes[rest])[y == 1])
    least = q[int((1 - recall) * len(q))] if len(q) else 0.5
    return Network(*p, platt=(float(a), float(b)), threshold=float(least))


def largest(net: Network, text: str, start: int, end: int) -> float:
    """The largest probability of a candidate's windows."""
    return float(net.probabilities(np.array([window_codes(text, start, end, at) for at in window_starts(start, end)])).max())


def calibrate_on_windows(net: Network, findings: list[tuple[str, int, int, int, int]], recall: float = RECALL) -> Network:
    """The network with a threshold at which the largest of the windows' probabilities, too, recalls so many of the true findings."""
    q = sorted(largest(net, text, a, b) for text, a, b, s, e in findings if e > s)
    return replace(net, threshold=min(net.threshold, q[int((1 - recall) * len(q))])) if q else net


@cache
def default_network() -> Network:
    return calibrate_on_windows(fit(*labelled_findings()), long_findings())


def scan(texts: pa.Array, net: Network) -> list[list[tuple[int, int, int]]]:
    """All findings of each text: (start, kind number, end), in order."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offs = V.buffers(texts)
    starts, ends, first = V.word_spans(data, offs, ~_RUN)
    long = np.flatnonzero(ends - starts >= 16)
    look = pc.match_substring_regex(texts, _ASSIGNS).to_numpy(zero_copy_only=False).copy()
    look[np.searchsorted(first, long, "right") - 1] = True
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    codes, of, where, best = [], [], [], []

    def judge():
        for k, p in zip(of, net.probabilities(np.array(codes)).tolist()):
            best[k] = max(best[k], p)
        codes.clear()
        of.clear()

    for i in np.flatnonzero(look).tolist():
        text = texts[i].as_py()
        out[i] = base_findings(text)
        for c in CANDIDATE.finditer(text):
            where.append((i, *c.span()))
            best.append(0.0)
            for at in window_starts(*c.span()):
                codes.append(window_codes(text, *c.span(), at))
                of.append(len(best) - 1)
                if len(codes) >= CHUNK:
                    judge()
    if codes:
        judge()
    merged: dict[int, tuple[list[int], list[int]]] = {}
    found: list[list[tuple[int, int, int]]] = [[] for _ in out]
    for (i, a, b), p in zip(where, best):
        if p >= net.threshold:
            if i not in merged:
                merged[i] = union(out[i])
            if not within(a, b, merged[i]):
                found[i].append((a, 3, b))
    return [sorted(x + y) for x, y in zip(out, found)]


def union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the union of spans, in order."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def within(start: int, end: int, base: tuple[list[int], list[int]]) -> bool:
    """Whether one interval of a union holds all of start to end."""
    k = bisect_right(base[0], start) - 1
    return k >= 0 and base[1][k] >= end


def covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether the union of the base findings among ``spans`` holds all of start to end."""
    return within(start, end, union([s for s in spans if s[1] < 3]))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    net = net or default_network()

    def run(batches):
        for b in V.text_slices(batches):
            found = scan(b.column("text"), net)
            n = [np.array([sum(k == kind for _, k, _ in x) for x in found], np.int64) for kind in range(3)]
            base = [hashlib.sha256(_written([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
            yield batch("doc_id n_assign n_access n_hex base_sha256 spans", b.column("doc_id"), *n, base, pa.array([_written(x) for x in found], pa.string()))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with the union of the spans replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """All documents, findings in ``text`` replaced by a mark; ``n_chars``, where there is such a column, follows for changed texts."""
    net = net or default_network()
    names = docs.columns

    def run(batches):
        for b in V.text_slices(batches):
            found = scan(b.column("text"), net)
            hit = [i for i, x in enumerate(found) if x]
            columns = {c: b.column(c) for c in names}
            if hit:
                text = columns["text"].to_pylist()
                for i in hit:
                    text[i] = redact(text[i], found[i])
                columns["text"] = pa.array(text, b.column("text").type)
                if "n_chars" in columns:
                    n = columns["n_chars"].to_pylist()
                    for i in hit:
                        n[i] = len(text[i])
                    columns["n_chars"] = pa.array(n, b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)
