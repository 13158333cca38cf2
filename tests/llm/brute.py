"""Plain versions of the training-data operators, one document after the other."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

from quillmesh.llm import langid, mixing, pii, toxicity

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, entity) by start and kind."""
    out = []
    for o, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), o, m.end(), f"{kind}:{m[0].lower() if o < 2 else digits}"))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'term')[o]}:{a}:{b}" for a, o, b in sorted(spans))


def pii_spans(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Base and term spans of each text, every pair of entity and term judged by its own counts."""
    base = [base_spans(t or "") for t in texts]
    held = [{e for *_, e in b} for b in base]
    words = [[(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{3,}", t or "")] for t in texts]
    sets = [{w for *_, w in ws} for ws in words]
    n_t, n_c, n_ct = Counter(w for s in sets for w in s), Counter(e for h in held for e in h), Counter()
    for h, s in zip(held, sets, strict=True):
        n_ct.update((e, w) for e in h for w in s)
    n = len(texts)

    def discloses(e: str, w: str) -> bool:
        known = n_c[e] / n
        if n_c[e] >= n:
            return False
        share = -math.log2((n_ct[e, w] + pii.PRIOR * known) / (n_t[w] + pii.PRIOR) / known) / math.log2(known)
        return share >= pii.DISCLOSURE

    out = []
    for b, h, ws in zip(base, held, words, strict=True):
        terms = [(s, len(KINDS), e) for s, e, w in ws if any(discloses(c, w) for c in h) and not any(x <= s and e <= y for x, _, y, _ in b)]
        out.append(sorted([(s, o, e) for s, o, e, _ in b] + terms))
    return out


def sanitised(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, o, b in spans:
        if a >= at:
            out += [text[at:a], "" if o == len(KINDS) else f"<{KINDS[o]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def lexicon(rows: list[tuple[int, str | None]], labels: list[tuple[int, int | None]]) -> tuple[dict[str, float], set[str]]:
    """(weights, learned exception phrases) from rows (id, text), distinct ids, and labels (id, toxic)."""
    toxic = defaultdict(int)
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            toxic[i] = max(toxic[i], y)
    train = [(toxic[i], toxicity.fold(t)[0].split()) for i, t in rows if i in toxic]
    p, n = sum(y > 0 for y, _ in train), sum(y <= 0 for y, _ in train)
    counts = (Counter(), Counter())
    for y, words in train:
        counts[y > 0].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in toxicity.STEMS if k <= len(w)})
    weights = {}
    for t, a in counts[1].items():
        w = math.log((a + 0.5) / (p + 1)) - math.log((counts[0][t] + 0.5) / (n + 1))
        if a >= toxicity.MIN_SUPPORT and w >= toxicity.MIN_WEIGHT:
            weights[t] = w
    pairs = (Counter(), Counter())
    for y, words in train:
        harsh = [any(t in (f" {w} ", *(f" {w[:k]}" for k in toxicity.STEMS if k <= len(w))) for t in weights) for w in words] if len(weights) < 50 else [
            f" {w} " in weights or any(f" {w[:k]}" in weights for k in toxicity.STEMS if k <= len(w)) for w in words]
        pairs[y > 0].update({f"{a} {b}" for a, b, x, z in zip(words, words[1:], harsh, harsh[1:], strict=False) if x or z})
    return weights, {t for t, c in pairs[0].items() if c >= toxicity.MIN_SUPPORT and not pairs[1][t]}


def evidence(text: str | None, lex: toxicity.Lexicon) -> float:
    """Every word against every term and every phrase, by plain comparison."""
    folded, n = toxicity.fold(text)
    words = folded.split()
    phrases = [toxicity.fold(p)[0].split() for p in lex.exceptions]
    excused = set()
    for k in range(len(words)):
        for p in phrases:
            if words[k : k + len(p)] == p:
                excused.update(range(k, k + len(p)))
    best: dict[str, float] = {}
    for k, w in enumerate(words):
        hits = [x for t, x in lex.weights.items() if (t == f" {w} " or (not t.endswith(" ") and f" {w}".startswith(t)))]
        if hits and k not in excused:
            best[w] = max(best.get(w, 0.0), *hits)
    return sum(best.values()) / (1 + 0.25 * math.log1p(n / toxicity.LENGTH_WORDS))


def language(text: str | None, dictionaries: dict[str, bytes]) -> str:
    """The dictionary that compresses the text's letters best, each block by a compressor of its own."""
    import zstandard as z

    if not text or not regex.search(r"\p{L}", text) or not dictionaries:
        return "und"
    raw = langid.normal(text)
    sizes = {}
    for name, held in dictionaries.items():
        sizes[name] = 0
        for k in range(0, len(raw), langid.BLOCK_BYTES):
            d = z.ZstdCompressionDict(held, dict_type=z.DICT_TYPE_RAWCONTENT)
            sizes[name] += len(z.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[k : k + langid.BLOCK_BYTES]))
    return min(sizes, key=sizes.__getitem__)


def copies(rows: list[tuple]) -> Counter:
    """How often each row (id, text, source) is replicated."""
    sizes: dict = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t or "")
    sizes = {s: float(max(n, 1)) for s, n in sizes.items()}
    weights = {s: math.sqrt(n) for s, n in sizes.items()}
    out: Counter = Counter()
    for i, t, s in rows:
        rate = weights[s] / sum(weights.values()) * sum(sizes.values()) / sizes[s]
        parts = max(math.ceil(rate / mixing.PART), 1)
        part, n = rate / parts, 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-part)
            k = 0
            while k <= mixing.TERMS and c <= u:
                n += 1
                k += 1
                p = p * part / k
                c += p
        out[(i, t)] += n
    return out
