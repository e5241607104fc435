"""The contracts again, as plainly as they can be said."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").encode().translate(LOWER))


def shingles(text, n=5):
    w = words(text, SPACED)
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {b" ".join(w)} if w else set()


def components(docs):
    """{position: (set size, smallest id reachable)} of (id, text) rows."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]


def substring_dedup(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def line_dedup(docs, size=3):
    """Kept texts of (id, text) rows in the order of ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        gone = set()
        for k in range(len(full) - size + 1):
            window = tuple(lines[i] for i in full[k : k + size])
            if window in seen:
                gone.update(range(full[k], full[k + size - 1] + 1))
            seen.add(window)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def contamination(texts, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= items_here
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def languages(content, texts, short, piece):
    """(language, score, rejected) of each text: plain zstandard sizes under each raw dictionary."""
    import re
    from itertools import groupby

    import zstandard

    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0, True))
            continue
        raw = (" " + " ".join(k for k, _ in groupby(re.sub(r"[\W\d_]+", " ", text.lower()).split())) + " ").encode()
        sizes = []
        for rank, (lang, body) in enumerate(content.items()):
            n = 0
            for i in range(0, len(raw), piece):
                words = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made = zstandard.ZstdCompressor(level=19 if len(raw) < short else 3, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[i : i + piece])
                assert zstandard.ZstdDecompressor(dict_data=words).decompress(made, max_output_size=piece) == raw[i : i + piece]
                n += len(made)
            sizes.append((n, rank, lang))
        best, second = sorted(sizes)[:2]
        margin = (second[0] - best[0]) / max(second[0], 1)
        out.append((best[2], min(1.0, 0.5 + 5 * margin), margin < 0.01))
    return out


# --- FLAC, one bit after the other, as its format is described ---


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> i & 1 for i in reversed(range(width))]

    def bytes(self):
        whole = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, whole[i : i + 8])), 2) for i in range(0, len(whole), 8))


class BitReader:
    def __init__(self, data, at=0):
        self.data, self.at = data, at * 8

    def take(self, width):
        value = 0
        for _ in range(width):
            value = value << 1 | self.data[self.at >> 3] >> (7 - self.at % 8) & 1
            self.at += 1
        return value

    def signed(self, width):
        value = self.take(width)
        return value - (1 << width) if width and value >> (width - 1) else value

    def unary(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def crc(data, polynomial, width):
    value = 0
    for byte in data:
        for i in reversed(range(8)):
            top = (value >> (width - 1) ^ byte >> i) & 1
            value = (value << 1 & (1 << width) - 1) ^ (polynomial if top else 0)
    return value


SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def utf8_number(n):
    if n < 128:
        return [n]
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.insert(0, 128 | n & 63)
        n >>= 6
    return [(0xFF << (7 - len(tail))) & 0xFF | n, *tail]


def write_subframe(w, x, width, how):
    """how: ('verbatim',) | ('constant',) | (order or weights, shift, partition order, wide, wasted, raw partitions)."""
    if how[0] in ("constant", "verbatim"):
        w.put(int(how[0] == "verbatim") << 1, 8)
        for v in x[:1] if how[0] == "constant" else x:
            w.put(v & (1 << width) - 1, width)
        return
    weights, shift, po, wide, wasted, raw = how
    fixed = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
    lpc = not isinstance(weights, int)
    order = len(weights) if lpc else weights
    w.put(((31 + order if lpc else 8 + order) << 1) | (wasted > 0), 8)
    if wasted:
        w.put(1, wasted)
    x, width = [v >> wasted for v in x], width - wasted
    for v in x[:order]:
        w.put(v & (1 << width) - 1, width)
    if lpc:
        w.put(14, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c & (1 << 15) - 1, 15)
    coefficients, down = (weights, shift) if lpc else (fixed[order], 0)
    e = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> down) for i in range(order, len(x))]
    w.put(int(wide), 2)
    w.put(po, 4)
    size, at = len(x) >> po, 0
    for part in range(1 << po):
        n = size - (order if part == 0 else 0)
        mine, at = e[at : at + n], at + n
        folded = [v << 1 if v >= 0 else (-v << 1) - 1 for v in mine]
        if part in raw:
            bits = max((v.bit_length() for v in folded), default=0)
            w.put(31 if wide else 15, 5 if wide else 4)
            w.put(bits, 5)
            for v in mine:
                w.put(v & (1 << bits) - 1, bits)
            continue
        k = min(max(0, (sum(folded) // max(len(folded), 1)).bit_length() - 1), 30 if wide else 14)
        w.put(k, 5 if wide else 4)
        for v in folded:
            w.put(0, v >> k)
            w.put(1, 1)
            w.put(v & (1 << k) - 1, k)


def write_flac(frames, width, channels, rate=8000, variable=False, seek=(), md5=True):
    """frames: (samples by channel, stereo code, ways of each channel); seek: numbers of the frames in the table."""
    bodies, first, total = [], [], 0
    for number, (samples, code, ways) in enumerate(frames):
        n = len(samples[0])
        size_code = next((c for c, v in SIZES.items() if v == n), 6 if n <= 256 else 7)
        head = bytes([0xFF, 0xF8 | variable, size_code << 4, code << 4 | {v: c for c, v in WIDTHS.items()}.get(width, 0) << 1, *utf8_number(total if variable else number)])
        head += (n - 1).to_bytes(1 if size_code == 6 else 2, "big") if size_code in (6, 7) else b""
        w = BitWriter()
        left, right = samples[0], samples[-1]
        sent = {8: [left, [a - b for a, b in zip(left, right)]], 9: [[a - b for a, b in zip(left, right)], right], 10: [[(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]]}.get(code, samples)
        for c, (x, how) in enumerate(zip(sent, ways)):
            write_subframe(w, x, width + (c == {8: 1, 9: 0, 10: 1}.get(code)), how)
        body = head + bytes([crc(head, 7, 8)]) + w.bytes()
        bodies.append(body + crc(body, 0x8005, 16).to_bytes(2, "big"))
        first.append(total)
        total += n
    pcm = b"".join((v).to_bytes((width + 7) // 8, "little", signed=True) for samples, _, _ in frames for row in zip(*samples) for v in row)
    block = len(frames[0][0][0])
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (width - 1) << 36 | total).to_bytes(8, "big") + (hashlib.md5(pcm).digest() if md5 else bytes(16))
    points = b"".join(first[i].to_bytes(8, "big") + sum(map(len, bodies[:i])).to_bytes(8, "big") + len(frames[i][0][0]).to_bytes(2, "big") for i in seek)
    table = b"\x03" + len(points).to_bytes(3, "big") + points if points else b""
    comment = b"\x84" + (4).to_bytes(3, "big") + b"note"
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + table + comment + b"".join(bodies)


def read_flac(data):
    """(samples by channel, bits a sample), read bit by bit with every checksum."""
    assert data[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            packed, digest = int.from_bytes(data[at + 14 : at + 22], "big"), data[at + 22 : at + 38]
        at += 4 + n
    default = (packed >> 36 & 31) + 1
    out = [[] for _ in range((packed >> 41 & 7) + 1)]
    while at < len(data):
        r = BitReader(data, at)
        assert r.take(15) == 0x7FFC
        r.take(1)
        size_code, rate_code, code, width_code = r.take(4), r.take(4), r.take(4), r.take(3)
        r.take(1)
        extra = r.take(8)
        for _ in range(next((i for i in range(8) if not extra >> (7 - i) & 1), 7) - 1 if extra & 128 else 0):
            r.take(8)
        size = r.take(8) + 1 if size_code == 6 else r.take(16) + 1 if size_code == 7 else SIZES[size_code]
        r.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        assert crc(data[at : r.at // 8], 7, 8) == r.take(8)
        width, got = WIDTHS.get(width_code, default), []
        for c in range(code + 1 if code < 8 else 2):
            got.append(read_subframe(r, size, width + (c == {8: 1, 9: 0, 10: 1}.get(code))))
        r.at = -(-r.at // 8) * 8
        assert crc(data[at : r.at // 8], 0x8005, 16) == r.take(16)
        at = r.at // 8
        if code == 8:
            got[1] = [a - b for a, b in zip(*got)]
        elif code == 9:
            got[0] = [a + b for a, b in zip(*got)]
        elif code == 10:
            got = [[((m << 1 | s & 1) + s) >> 1 for m, s in zip(*got)], [((m << 1 | s & 1) - s) >> 1 for m, s in zip(*got)]]
        for have, more in zip(out, got):
            have += more
    pcm = b"".join(v.to_bytes((default + 7) // 8, "little", signed=True) for row in zip(*out) for v in row)
    assert digest in (bytes(16), hashlib.md5(pcm).digest())
    return out, default


def read_subframe(r, size, width):
    assert r.take(1) == 0
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    width -= wasted
    if kind == 0:
        return [r.signed(width) << wasted] * size
    if kind == 1:
        return [r.signed(width) << wasted for _ in range(size)]
    order = kind - 31 if kind >= 32 else kind - 8
    x = [r.signed(width) for _ in range(order)]
    weights, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order) if kind < 32 else None, 0
    if kind >= 32:
        precision, shift = r.take(4) + 1, r.take(5)
        weights = [r.signed(precision) for _ in range(order)]
    wide, po = r.take(2), r.take(4)
    for part in range(1 << po):
        k = r.take(5 if wide else 4)
        raw = r.take(5) if k == (31 if wide else 15) else None
        for _ in range((size >> po) - (order if part == 0 else 0)):
            if raw is not None:
                e = r.signed(raw)
            else:
                u = r.unary() << k | r.take(k)
                e = u >> 1 if not u & 1 else -(u + 1 >> 1)
            x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(weights)) >> shift))
    return [v << wasted for v in x]


def alignment(texts, path_a, path_b):
    """Rows of op11 by the two libraries on whole texts, one text after another."""
    import hashlib
    from collections import Counter

    import sentencepiece
    import tokenizers

    from keyweave.llm.bpe import _byte_letters

    first = tokenizers.Tokenizer.from_file(path_a)
    first.encode_special_tokens = True
    second, letters = sentencepiece.SentencePieceProcessor(model_file=path_b), _byte_letters()
    told, documents = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = first.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[x] for x in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            told.append(None)
            continue
        groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                groups[-1][0].append(a[i])
                end_a += len(bytes_a[i])
                i += 1
            else:
                groups[-1][1].append(b[j])
                end_b += len(bytes_b[j])
                j += 1
            if end_a == end_b:
                groups.append(([], []))
        groups.pop()
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        documents.update(links.keys())
        told.append((len(a), len(b), groups, links))
    top = {}
    for (x, _), n in documents.items():
        top[x] = max(top.get(x, 0), n)
    for row in told:
        if row is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = row
        written = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        best = sum(n for pair, n in links.items() if documents[pair] == top[pair[0]])
        yield (n_a, n_b, len(groups), sum(links.values()), best, sum(n * documents[pair] for pair, n in links.items()), hashlib.sha256(written.encode()).hexdigest())


def audit(rows, labels):
    """Rows of op12: every order applied to every document in turn."""
    import re
    from collections import defaultdict
    from itertools import permutations

    def failures(i, text):
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(found) < 200, 100 * len(set(found)) < 50 * len(found), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows))
        return {x for x, failed in zip("ABCDE", tests, strict=True) if failed}

    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    out, names = defaultdict(lambda: [0] * 7), ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for i, text, part in rows:
        failed = failures(i, text or "")
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                cell = out[part or "", order, step]
                now = x in failed
                for k, hit in enumerate((not gone and not now, not gone and now, gone and now, failed == {x}, not gone and now and i in good, not gone and now and i in toxic)):
                    cell[k] += hit
                gone |= now
    totals = defaultdict(int)
    for (part, order, step), cell in out.items():
        totals[part, order[step - 1]] += cell[names.index("removed")]
    return sorted((*key, *cell[:6], totals[key[0], key[1][key[2] - 1]]) for key, cell in out.items())


def article(page):
    """The blocks of the first article element, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag == "br":
                self.blocks[-1] += " "
            elif tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
