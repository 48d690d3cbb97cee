"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations, takewhile

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, window=35):
    seen = Counter()
    split = [(i, words(t)) for i, t in docs]
    for _, w in split:
        seen.update(tuple(w[k:k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffixes(docs, length=50):
    least = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            if s not in least or i < least[s]:
                least[s] = i
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if least[b[k:k + length]] < i:
                gone[k:k + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def bpe(docs, path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    out = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def token_rows(docs, path):
    tok = Tokenizer.from_file(path)
    start, out = 0, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def quality(docs):
    out = []
    for i, t in docs:
        w = words(t)
        triples = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        seen, covered = Counter(triples), set()
        for k, x in enumerate(triples):
            if seen[x] > 1:
                covered.update(range(k, k + 3))
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), failed))
    return out


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    out = []
    for i, t in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        n = Counter(s[3] for s in spans)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(told.encode()).hexdigest()))
    return out


def topk(rows, k=5, every=50, scale=256):
    sound = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in sound if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1))


def near(docs, threshold=0.8):
    """(links by set, group by set): of distinct shingle sets."""
    sets = list({shingles(t): 0 for _, t in docs})
    held = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            held[x].add(k)
    links = defaultdict(set)
    for k, s in enumerate(sets):
        near_k = Counter(j for x in s for j in held[x])
        for j, n in near_k.items():
            if j != k and n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[k].add(j)
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, bs in links.items():
        for b in bs:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return ({s: len(links[k]) for k, s in enumerate(sets)}, {s: find(k) for k, s in enumerate(sets)})


def filter_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        fails.append((i, part or "", {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}))
    out = []
    for part in {p for _, p, _ in fails}:
        own = [(i, x) for i, p, x in fails if p == part]
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                shapley[f] += len(gone)
                rows.append((f, part, "".join(order), step + 1, len(left), len(gone), sum(x[f] for _, x in own) - len(gone),
                             sum(x[f] and sum(x.values()) == 1 for _, x in own), sum(i in good for i, _ in gone if i is not None),
                             sum(i in toxic for i, _ in gone if i is not None)))
        out += [(*r[1:], shapley[r[0]]) for r in rows]
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def unigrams(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score), one list entry per row."""
    split = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*words(lower(t)), None]) for i, t in docs]
    c = Counter(w for _, held, ws in split if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for i, held, ws in split], c


def pieces(path):
    """Entry (bytes) -> first probability."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight = {bytes([b]): 1 / (2 + model.get_piece_size()) for b in range(256)}
    for k in range(model.get_piece_size()):
        p = re.sub("[A-Z]", lambda m: m[0].lower(), model.id_to_piece(k)).replace("▁", " ")
        if k > 2 and not model.is_byte(k) and " " not in p[1:] and not re.search("[\t-\r]", p):
            weight[p.encode()] = max(weight.get(p.encode(), 0), 1 / (2 - min(0, model.get_score(k))))
    total = sum(weight.values())
    return {p: w / total for p, w in weight.items()}


def marginal(word, p):
    """(probability, expected count of each entry) by summing over all segmentations."""
    data = b" " + word.encode()
    n = len(data)
    fits = [[(j, data[i:j]) for j in range(i + 1, min(n, i + 40) + 1) if data[i:j] in p] for i in range(n)]
    ahead = [0.0] * n + [1.0]
    for i in reversed(range(n)):
        ahead[i] = sum(p[x] * ahead[j] for j, x in fits[i])
    before = [1.0] + [0.0] * n
    expected = Counter()
    for i in range(n):
        for j, x in fits[i]:
            before[j] += before[i] * p[x]
            if ahead[0]:
                expected[x] += before[i] * p[x] * ahead[j] / ahead[0]
    return ahead[0], expected


def lattice_scores(docs, path, rounds, prior):
    """log10 of each row's marginal probability; for words short enough not to underflow."""
    rows, c = unigrams(docs)
    start = pieces(path)
    p, told = start, 0.0
    for _ in range(rounds):
        seen = Counter()
        for w, n in c.items():
            if w is not None:
                for x, e in marginal(w, p)[1].items():
                    seen[x] += n * e
        told = sum(seen.values())
        p = {x: (seen[x] + prior * len(start) * q) / (told + prior * len(start)) for x, q in start.items()}
    end = (c[None] + 1) / (c[None] + 1 + told + prior * len(start))
    p = {x: q * (1 - end) for x, q in p.items()}
    return [sum(math.log10(marginal(w, p)[0]) for w in words(lower(t))) + math.log10(end) for _, t in docs]


def alignment(docs, path_a, path_b):
    """Whole texts through both libraries, byte ranges compared token by token."""
    tok = Tokenizer.from_file(path_a)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}
    told, links = [], []
    for i, t in docs:
        data = (" " + (t or "")).encode()
        a, b = tok.encode(" " + (t or ""), add_special_tokens=False).ids, model.encode(t or "")
        bytes_a = [bytes(byte_of[c] for c in tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(model.id_to_piece(x)[3:5], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            told.append((i, 0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids)))
        groups = []
        ends_a, ends_b = {e for _, e, _ in spans[0]}, {e for _, e, _ in spans[1]}
        ka = kb = 0
        for end in sorted(ends_a & ends_b):
            own_a = list(takewhile(lambda x: x[1] <= end, (spans[0][k] for k in range(ka, len(spans[0])))))
            own_b = list(takewhile(lambda x: x[1] <= end, (spans[1][k] for k in range(kb, len(spans[1])))))
            of_a, of_b = [x for *_, x in own_a], [x for *_, x in own_b]
            groups.append((of_a, of_b, [(x, y) for s, e, x in own_a for s2, e2, y in own_b if s < e2 and s2 < e]))
            ka, kb = ka + len(of_a), kb + len(of_b)
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in groups)
        links.append([p for *_, ps in groups for p in ps])
        told.append((i, len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(text.encode()).hexdigest()))
    count = Counter(p for ps in links for p in ps)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(*x[:5], sum(count[p] == best[p[1]] for p in ps), sum(count[p] for p in ps), x[5]) for x, ps in zip(told, links)]
