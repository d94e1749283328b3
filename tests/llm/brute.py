"""Plain versions of the operators' contracts, one text or one small table at a time."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import xxhash

WS = re.compile(r"[\x20\x09-\x0D]")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def bpe(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("brute", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for t in texts:
        ids = own.encode_ordinary(t or "")
        out.append((len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(ids, fps, budget=2):
    """Smallest id reachable, for each row."""
    distinct = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(distinct)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, f in enumerate(distinct):
        bits = np.unpackbits((distinct[i + 1 :] ^ f).reshape(-1, 1).view(np.uint8), axis=1).sum(axis=1)
        for j in np.flatnonzero(bits <= budget):
            parent[top(i + 1 + int(j))] = top(i)
    at = {int(f): i for i, f in enumerate(distinct)}
    least = {}
    for k, f in zip(ids, fps, strict=True):
        r = top(at[f])
        least[r] = min(least.get(r, k), k)
    return [least[top(at[f])] for f in fps]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def as_text(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return [(m.start(), k, m.end()) for k, (p, keep) in enumerate(kinds) for m in re.finditer(p, text) if keep(m[0])]


def secrets(text):
    text = text or ""
    kinds = [
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    return [(m.start(), k, m.end()) for k, (p, keep) in enumerate(kinds) for m in re.finditer(p, text) if keep(m)]


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def exact(rows):
    """rows: (doc_id, text); (doc_id, keep_id, group_size, kept, sha) each, for rows of different ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[WS.sub("", t or "")].append((-len(t or ""), i))
    out = []
    for i, t in rows:
        norm = WS.sub("", t or "")
        keep = min(groups[norm])[1]
        out.append((i, keep, len(groups[norm]), i == keep, sha(norm.encode())))
    return out


def token_count(texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return [len(own.encode(t or "")) for t in texts]


def word_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def lookup_table(shards, slots):
    """Shards take turns by name; each claims the first free slot of offset, offset + skip, offset + 2 skip, ..."""
    names = sorted(shards)
    orders = []
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    owner = {}
    turn = 0
    while len(owner) < slots:
        k = turn % len(names)
        owner[next(x for x in orders[k] if x not in owner)] = k
        turn += 1
    return [owner[i] for i in range(slots)]


def slot(key, slots):
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % slots


def kept(rows, prior=200, upper=0.9, reach=6.0, slack=(0.1, 0.3, 6.0)):
    """Verdicts for rows (text, lang, source) with exact quantiles, which a sketch gives for so few rows."""
    stats = [quality(t) for t, *_ in rows]
    ratios = [(s[2] / max(s[0], 1), s[3] / max(s[0] / 10, 1.0), s[1] / max(s[0], 1)) for s in stats]

    def fences(own):
        out = []
        for k in range(3):
            v = sorted(r[k] for r in own)
            at = lambda q: v[max(0, -(-int(round(q * len(v) * 1000)) // 1000) - 1)]  # noqa: B023, E731
            out.append(at(upper) + max(reach * (at(upper) - at(0.5)), slack[k]))
        return len(own), out

    groups = defaultdict(list)
    for r, (_, lang, source) in zip(ratios, rows, strict=True):
        groups[lang, source].append(r)
        groups[lang].append(r)
    every = fences(ratios)[1] if rows else None
    made = {key: fences(own) for key, own in groups.items()}
    out = []
    for s, r, (_, lang, source) in zip(stats, ratios, rows, strict=True):
        ok = s[0] >= 10 and 100 * s[4] <= 20 * s[0]
        for k in range(3):
            (n, own), (m, wide) = made[lang, source], made[lang]
            limit = (m * wide[k] + prior * every[k]) / (m + prior)
            ok = ok and r[k] <= (n * own[k] + prior * limit) / (n + prior)
        out.append(ok)
    return out


def similar_components(sets, similarity=0.8):
    """For each set the number of the first one that similar pairs lead to."""
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(sets))]


def redacted(text):
    """Overlapping secrets as one mark."""
    runs = []
    for a, _, b in sorted(secrets(text)):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    for a, b in reversed(runs):
        text = text[:a] + "[secret]" + text[b:]
    return text


def pii_candidates(text, base):
    """(start, stop, kinds, left, right, value): runs of tokens with a digit or an @ that look like identifiers, or else their tokens."""
    import regex

    token = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
    runs = list(regex.finditer(rf"(?<![^\x20\x09-\x0D]){token}(?:\x20{token})*+", text))
    digits = lambda v: len(re.sub("[^0-9]", "", v))
    shapes = [
        lambda v: v.count("@") == 1 and 0 < v.index("@") < len(v) - 1,
        lambda v: digits(v) > 0 and re.fullmatch("[0-9A-Fa-f.:]+", v) is not None and len(re.findall("[.:]", v)) >= 2,
        lambda v: re.fullmatch(r"[0-9](?:[\x20.-]?[0-9])+", v) is not None and 12 <= digits(v) <= 19,
        lambda v: re.fullmatch(r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])+", v) is not None and 7 <= digits(v) <= 15,
    ]

    def bare(start, value):
        head = re.sub("^[^A-Za-z0-9+(]+", "", value)
        tail = re.sub("[^A-Za-z0-9]+$", "", head)
        own = tail[1:] if tail[:1] == "(" and ")" not in tail else tail
        first = start + len(value) - len(head) + len(tail) - len(own)
        kinds = [k for k, f in enumerate(shapes) if f(own)]
        return (first, first + len(own), kinds, own) if kinds and not any(a < first + len(own) and first < b for a, _, b in base) else None

    out = []
    for n, m in enumerate(runs):
        left, right = beside(text[runs[n - 1].end() if n else 0 : m.start()], text[m.end() : runs[n + 1].start() if n + 1 < len(runs) else len(text)])
        found = [bare(m.start(), m[0])]
        if found == [None]:
            at, found = m.start(), []
            for t in m[0].split(" "):
                found.append(bare(at, t))
                at += len(t) + 1
        out += [(c[0], c[1], c[2], left, right, c[3]) for c in found if c]
    return out


def beside(before, after):
    """The last word before and the first one after, bare and in lower case."""
    import regex

    words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in (before, after)]
    return tuple(regex.sub(r"[^\p{L}\p{N}]+", "", x[i]).lower() if x else "" for x, i in zip(words, (-1, 0), strict=True))


def pii_spans(texts, support=4, confidence=0.5, rounds=4):
    """All spans of each text by the bootstrapped method: base spans and what patterns find."""
    import regex

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9]){13,}", r"\+[0-9][\x20().0-9-]+[0-9]"]
    texts = [t or "" for t in texts]
    base = [pii(t) for t in texts]
    edges, open_, words_of = set(), [], defaultdict(set)
    for n, t in enumerate(texts):
        for k, p in enumerate(patterns):
            found = list(re.finditer(p, t))
            for i, m in enumerate(found):
                if (m.start(), k, m.end()) in base[n]:
                    left, right = beside(t[found[i - 1].end() if i else 0 : m.start()], t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)])
                    edges |= {(c, k, m[0], True) for c in ("<" + left, ">" + right) if len(c) > 1}
        for start, stop, kinds, left, right, value in pii_candidates(t, base[n]):
            own = [c for c in ("<" + left, ">" + right) if len(c) > 1]
            edges |= {(c, k, value, False) for c in own for k in kinds}
            open_.append((n, start, stop, value, own))
        for w in re.split(r"[\x20\x09-\x0D]+", regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", "", t).lower()):
            words_of[w].add(t)
    often = Counter((c, k) for c, k, *_ in edges)
    edges = {e for e in edges if often[e[:2]] >= support and words_of[e[0][1:]]}
    seeds = {(k, v) for _, k, v, seed in edges if seed}
    score = {s: 1.0 for s in seeds}
    found = {}
    for _ in range(rounds):
        total, known = defaultdict(float), Counter()
        for c, k, v, _ in edges:
            total[c, k] += score.get((k, v), 0.0)
            known[c, k] += score.get((k, v), 0.0) >= confidence
        found = {p: min(1.0, total[p] / len(words_of[p[0][1:]])) for p in total if known[p] >= support}
        miss = defaultdict(lambda: 1.0)
        for c, k, v, _ in edges:
            if (c, k) in found:
                miss[k, v] *= 1 - found[c, k]
        score = {key: 1 - m for key, m in miss.items()} | {s: 1.0 for s in seeds}
    best = {}
    for (k, v), s in score.items():
        if s >= confidence:
            best[v] = max(best.get(v, (0, -9)), (s, -k))
    out = [set(b) for b in base]
    for n, start, stop, value, own in open_:
        if value in best:
            k = -best[value][1]
            if any((c, k) in found and (c, k, value, False) in edges for c in own):
                out[n].add((start, k, stop))
    return out


def language_model(rows, model, rounds=2):
    """Languages and the probability of each piece (None: another character) in each, by expectation-maximisation over whole words."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    names = {own.id_to_piece(i).lower() for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))} - {""}
    names = sorted(names)
    counts = defaultdict(Counter)
    for text, lang in rows:
        counts[lang].update(plain_words(text))
    p = {lang: {x: 1.0 / (len(names) + 1) for x in [None, *names]} for lang in counts}
    for _ in range(rounds):
        for lang, words in counts.items():
            gain = Counter()
            for w, n in words.items():
                a, b = sums(w, p[lang]), sums(w[::-1], p[lang], True)
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + 16) + 1):
                        x = piece_in(w[i:j], p[lang])
                        if x is not False:
                            gain[x] += n * a[i] * p[lang][x] * b[len(w) - j] / a[-1]
            whole = sum(gain.values()) + 0.05 * (len(names) + 1)
            p[lang] = {x: (gain[x] + 0.05) / whole for x in p[lang]}
    return sorted(counts), p


def piece_in(x, p):
    return x if x in p else None if len(x) == 1 else False


def sums(word, p, turned=False):
    """For each length of a prefix the probability of all its segmentations; turned: word and pieces are read backwards."""
    a = [1.0]
    for j in range(1, len(word) + 1):
        total = 0.0
        for i in range(max(0, j - 16), j):
            x = piece_in(word[i:j][::-1] if turned else word[i:j], p)
            if x is not False:
                total += a[i] * p[x]
        a.append(total)
    return a


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append("▁" + word)
            word = ""
    return out


def repeats(rows, width=20):
    """rows: (doc_id, text), ids not null, of equal ids the first given first; (doc_id, n_words, n_removed, sha of what is kept) each."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen, out = set(), [None] * len(rows)
    for k in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[k] = (rows[k][0], len(words), sum(gone), sha(" ".join(kept).encode()))
    return out


def variants(rows, chars=7, least=2, times=10, drop_every=31):
    """rows: (doc_id, text); {word: (form, root, n, n_near, form_n)}."""
    import zlib

    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= chars:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if x != w and one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def resampled(docs, target, percent=5, least_words=20, seed=42):
    """docs: (doc_id, text); target: texts; {doc_id: (n_features, weight, score, rank)}."""
    import math
    import zlib

    def features(t):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1))

    own, wanted = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = (sum((f for _, f in x), Counter()) for x in (own, wanted))
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (s.total() + 10000.0) / ((s[k] + 1.0) * (t.total() + 10000.0)))) for k in range(10000)]
    out, able = {}, []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(k * gain[b] for b, k in f.items())
        h = int(sha(f"{seed}:{i}".encode())[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [f.total(), weight, score, None]
        if n >= least_words:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(x) for i, x in out.items()}
