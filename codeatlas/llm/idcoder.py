"""Adaptive context-mixing range coder for token ids, many independent blocks in lockstep.

A block starts from an empty model.  Order 2 and order 1 predict the id that last followed the same ids,
order 0 the block's most frequent id.  Whether the prediction of the highest order that has one is right
is a binary decision whose probability mixes the hit rates of the order-2 slot, of the order-1 slot and of
order 0, each by how far it agrees, in the logistic domain with weights learned as it goes.  A miss is coded
by an adaptive distribution over order 1's id, order 0's id and, for ids that none predicts, magnitude classes,
two a power of two; each miss is counted, and the counts move the distribution's bounds every ``REFRESH``
positions, sooner at first.  Ids may have 32 bits; a call whose ids fit 16 keeps smaller tables.
Everything is integer arithmetic, so any machine decodes what another encoded.  numpy works on one
position of all blocks at a time, in buffers made once; blocks of a call are its lanes.  Choices between two
arrays are made with masks of all or no bits, as numpy branches where lanes differ.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
LANES = 2048                        # at most 65,536
SLOTS = 12                          # log2 of the slots of a context table
MOST_ID = (1 << 32) - 2
HEAD = "<IIII"                      # ids, 16-bit words, crc32 of the ids, crc32 of the words

_STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int32)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-i / 256))))) for i in range(-2047, 2048)], np.int32)
# Class 2 * bits + second bit of the id plus one; class c begins at _BASE[c] and has 2 ** _EXTRA[c] ids.  No id has
# class 0 or 1: these stand for order 1's and order 0's id.
CLASSES, WIDE_CLASSES = 36, 68
_BASE = np.array([0, 0, 0, 0, *(((2 + c % 2) << (c // 2 - 2)) - 1 for c in range(4, WIDE_CLASSES))], np.int64)
_EXTRA = np.array([0, 0, 0, 0, *(c // 2 - 2 for c in range(4, WIDE_CLASSES))], np.int64)
_PLACES = (1 << _EXTRA) - 1
WIDE = 1 << 31                      # in a header's number of ids: coded with the larger tables
REFRESH = 128
EARLY = (4, 8, 16, 32, 48, 64, 96, 192)
CLASS_BITS = 10                     # of the classes' distribution
_LOW = 30                           # intervals are kept between 2^30 and 2^62 wide, words have 32 bits
_KEEP, _LEAST, _WORD = (1 << _LOW) - 1, 1 << _LOW, (1 << 32) - 1
# A slot is one integer: confidence (3 bits), how often its id came (order 1 only, 13 bits), the id that followed.
_COUNTED = (1 << 13) - 1
_TURN = np.array([*(k ^ min(k + 1, 7) for k in range(8)), *(k ^ (k >> 1) for k in range(8))], np.int32)     # change of confidence by a hit, a miss


def _classes(x: np.ndarray) -> np.ndarray:
    bits = np.frexp((x + 1).astype(np.float64))[1].astype(np.int64)
    return np.where(bits > 1, 2 * bits + (((x + 1) >> np.maximum(bits - 2, 0)) & 1), 2)


_CLASS = _classes(np.arange(1 << 16))


class _Encoder:
    """``value`` is the low end of a lane's interval; its bit 62 takes the carry, which ``finish`` hands on."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.value = np.zeros(ids.shape[1], np.int64)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def shift(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Take the top words of the lanes' values."""
        self.lanes.append(lanes.astype(np.uint16))
        self.words.append(value >> _LOW)
        return (value & _KEEP) << 32

    def finish(self) -> list[bytes]:
        lanes = np.concatenate([*self.lanes, np.arange(len(self.value), dtype=np.uint16)])
        words = np.concatenate([*self.words, (self.value + _KEEP) >> _LOW])[np.argsort(lanes, kind="stable")]
        carry = words >> 32
        while carry.any():
            words &= _WORD
            words[:-1] += carry[1:]
            carry = words >> 32
        ends = np.cumsum(np.bincount(lanes, minlength=len(self.value))).tolist()
        data = words.astype("<u4").tobytes()
        return [data[4 * a:4 * b] for a, b in zip([0, *ends], ends, strict=False)]


class _Decoder:
    """``value`` is how far the coded number lies above the low end of a lane's interval."""

    def __init__(self, payloads: list[bytes]):
        n, width = len(payloads), max(len(p) // 4 for p in payloads) + 4
        words = np.zeros((n, width), np.uint32)
        for i, p in enumerate(payloads):
            words[i, :len(p) // 4] = np.frombuffer(p, "<u4", len(p) // 4)
        self.value = (words[:, 0].astype(np.int64) << 30) | (words[:, 1] >> 2)
        words[:, 1:-1] = (words[:, 1:-1] << np.uint32(30)) | (words[:, 2:] >> np.uint32(2))         # what follows the first 62 bits
        self.words = words.ravel()
        self.pos = np.arange(n) * width + 1

    def shift(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        pos = self.pos[lanes]
        self.pos[lanes] = pos + 1
        return (value << 32) | self.words.take(pos, mode="clip")


def _intervals(freq: np.ndarray, table: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each class's interval of 2^CLASS_BITS, as start << 16 | width, and the class at each place."""
    n, classes = freq.shape
    total = freq.sum(1)
    full = (total > 1 << 13).nonzero()[0]
    freq[full] = (freq[full] + 1) >> 1
    total[full] = freq[full].sum(1)
    ends = np.cumsum(freq, axis=1)
    ends *= (1 << CLASS_BITS) - classes
    ends //= total[:, None]
    ends += np.arange(1, classes + 1)
    width = np.diff(ends, axis=1, prepend=0)
    at = np.repeat(np.tile(np.arange(classes, dtype=np.uint8), n), width.ravel()) if table else np.empty(0, np.uint8)
    return (((ends - width) << 16) | width).ravel(), at


def _count(freq: np.ndarray, events: list[np.ndarray]) -> None:
    if events:
        freq += 24 * np.bincount(np.concatenate(events), minlength=freq.size).reshape(freq.shape)
        events.clear()


def _run(coder, lengths: np.ndarray, wide: bool) -> np.ndarray:
    """Walk all lanes through the model; returns the ids, a row for each position.  Lanes come longest first,
    so those still running are a prefix."""
    encoding = isinstance(coder, _Encoder)
    n, most = len(lengths), int(lengths[0])
    kind, plain, id_bits, classes = (np.int64, np.uint64, 32, WIDE_CLASSES) if wide else (np.int32, np.uint32, 16, CLASSES)
    sign = 63 if wide else 31
    ids = coder.ids if encoding else np.zeros((most, n), np.uint32)
    size = 1 << SLOTS
    slots = np.full(2 * n * size, 0, kind)                          # order 2, then order 1
    rates = np.full(n * 32, 1 << 14, np.int32)                      # 16-bit hit rates by order 2's confidence, by order 1's
    #                                                                 and whether it agrees, by whether order 0 does
    weight = np.full((3, n), 1 << 15, np.int32)
    freq = np.ones((n, classes), np.int64)
    rng = np.full(n, 1 << 61)
    best = np.zeros(n, kind)                                        # how often the most frequent id came, and the id
    last, mixed = np.zeros((2, n), np.uint32)
    places, where = _intervals(freq, not encoding)
    ends = [0, *sorted(set(lengths.tolist()))]
    for begin, end in zip(ends, ends[1:], strict=False):            # while the same lanes run
        m = int(np.searchsorted(-lengths, -end, side="right"))
        lane = np.arange(m)
        base, base3 = np.stack([lane * size, (lane + n) * size]), np.stack([lane * 32, lane * 32 + 8, lane * 32 + 24])
        weight, freq = np.ascontiguousarray(weight[:, :m]), freq[:m]
        value, rng, best, b, prev = coder.value[:m], rng[:m], best[:m], last[:m], mixed[:m]
        h, u, s = np.empty((2, m), np.uint32), np.empty(m, np.uint32), np.empty((2, m), np.int64)
        k, e, free, d = np.empty((4, 2, m), kind)
        c = np.empty((3, m), kind)
        q, t3, z = np.empty((3, 3, m), np.int32)
        ri = np.empty((3, m), np.int64)
        slot, entry, rate, flat_q = s.reshape(-1), e.reshape(-1), ri.reshape(-1), q.reshape(-1)
        raw, ahead = e.view(plain), c[:2].view(plain)
        c1, c0 = c[1], c[2]
        first, x, often, is_hit = np.empty((4, m), kind)
        np.copyto(x, b, casting="unsafe")
        p, err, hit32 = np.empty((3, m), np.int32)
        bound, hit, tmp = np.empty((3, m), np.int64)
        missed = np.empty(m, bool)
        events: list[np.ndarray] = []
        places, where = places[:m * classes], where[:m << CLASS_BITS]
        for t in range(begin, end):
            # Slots of both contexts, and what they predict.
            np.multiply(b, np.uint32(0x9E3779B1), out=u)
            h[1] = u
            np.add(prev, u, out=h[0])
            np.left_shift(u, np.uint32(5), out=prev)
            h >>= np.uint32(32 - SLOTS)
            np.copyto(s, h)
            s += base
            slots.take(slot, out=entry, mode="clip")
            np.right_shift(raw, 16, out=ahead)
            np.bitwise_and(e, 7, out=k)
            if 0 < t <= _COUNTED:
                e[1] += 8
                np.bitwise_and(e[1], 8 * _COUNTED, out=often)
                often <<= id_bits - 3
                often |= x
                np.maximum(best, often, out=best)
                np.bitwise_and(best, (1 << id_bits) - 1, out=c0)
            elif t == 0:
                c0.fill(0)
            np.subtract(k, 1, out=free)
            free >>= sign                                           # -1 where a slot has no prediction
            np.bitwise_xor(c1, c0, out=first)
            first &= free[1]
            first ^= c1
            first ^= c[0]
            first &= free[0]
            first ^= c[0]
            # The probability that the prediction is right.
            np.bitwise_xor(c[1:], first, out=d)
            np.minimum(d, 1, out=d)
            d[0] <<= 3
            d[0] += k[1]
            ri[0] = k[0]
            ri[1:] = d
            ri += base3
            rates.take(rate, out=flat_q, mode="clip")
            np.right_shift(q, 4, out=z)
            _STRETCH.take(z, out=t3, mode="clip")
            np.multiply(weight, t3, out=z)
            dot = z[0]
            dot += z[1]
            dot += z[2]
            dot >>= 16
            dot += 2047
            _SQUASH.take(dot, out=p, mode="clip")
            # Is it?  Then ``hit`` is -1, else 0.
            np.right_shift(rng, 12, out=bound)
            np.copyto(tmp, p)
            bound *= tmp
            if encoding:
                np.copyto(x, ids[t, :m], casting="unsafe")
                np.bitwise_xor(x, first, out=is_hit)
                is_hit -= 1
                is_hit >>= sign
                np.copyto(hit, is_hit)
                value += bound
                np.bitwise_and(bound, hit, out=tmp)
                value -= tmp
            else:
                value -= bound
                np.right_shift(value, 63, out=hit)
                np.bitwise_and(bound, hit, out=tmp)
                value += tmp
                np.copyto(x, first)
            rng -= bound
            bound ^= rng
            bound &= hit
            rng ^= bound
            np.copyto(hit32, hit, casting="unsafe")
            np.bitwise_and(hit32, 4096, out=err)
            err -= p
            np.multiply(t3, err, out=z)
            z >>= 11
            weight += z
            np.bitwise_and(hit32, 65535, out=err)
            np.subtract(err, q, out=z)
            z >>= 4
            z[2] >>= 1
            q += z
            rates[rate] = flat_q
            # Ids that were missed.
            if t and t % REFRESH == 0 or t in EARLY:
                _count(freq, events)
                places, where = _intervals(freq, not encoding)
            np.equal(hit32, 0, out=missed)
            at = missed.nonzero()[0]
            if len(at):
                r, v, own1, own0 = rng.take(at), value.take(at), c1.take(at), c0.take(at)
                unit = r >> CLASS_BITS
                if encoding:
                    own = x.take(at).astype(np.int64)
                    cls = _classes(own) if wide else _CLASS.take(own)
                    np.copyto(cls, 1, where=own == own0)
                    np.copyto(cls, 0, where=own == own1)
                else:
                    i = v // unit
                    i += at << CLASS_BITS
                    cls = where.take(i, mode="clip").astype(np.int64)
                i = at * classes
                i += cls
                events.append(i)
                r = places.take(i, mode="clip")
                i = r >> 16
                i *= unit
                r &= 65535
                r *= unit
                if encoding:
                    v += i
                else:
                    v -= i
                go = (r < _LEAST).nonzero()[0]
                if len(go):
                    v[go] = coder.shift(at[go], v[go])
                    r[go] <<= 32
                r >>= _EXTRA.take(cls)
                if encoding:
                    own -= _BASE.take(cls)
                    own &= _PLACES.take(cls)
                    own *= r
                    v += own
                else:
                    place = v // r
                    own = place + _BASE.take(cls)
                    np.copyto(own, own1, where=cls == 0)
                    np.copyto(own, own0, where=cls == 1)
                    x[at] = own
                    place *= r
                    v -= place
                rng[at] = r
                value[at] = v
            np.less(rng, _LEAST, out=missed)
            go = missed.nonzero()[0]
            if len(go):
                value[go] = coder.shift(go, value[go])
                rng[go] <<= 32
            if not encoding:
                np.copyto(ids[t, :m], x, casting="unsafe")
            # What the slots hold from now on.
            np.bitwise_xor(c[:2], x, out=d)
            free &= d
            np.minimum(d, 1, out=d)
            d <<= 3
            d += k
            free <<= 16
            e ^= free
            e ^= _TURN.take(d, mode="clip")
            slots[slot] = entry
            np.copyto(b, x, casting="unsafe")
        _count(freq, events)
    return ids


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of unsigned 32-bit ids (at most ``MOST_ID``) -> each as header and payload; the blocks know nothing of
    each other."""
    if any(len(x) and int(x.max()) > MOST_ID for x in blocks):
        raise ValueError("an id above 2^32 - 2")
    out: list[bytes] = [b""] * len(blocks)
    for lo in range(0, len(blocks), LANES):
        order = sorted(range(lo, min(len(blocks), lo + LANES)), key=lambda i: -len(blocks[i]))
        lengths = np.array([len(blocks[i]) for i in order])
        wide = any(len(blocks[i]) and int(blocks[i].max()) >> 16 for i in order)
        ids = np.zeros((max(1, int(lengths[0])), len(order)), np.uint32)
        for r, i in enumerate(order):
            ids[:len(blocks[i]), r] = blocks[i]
        coder = _Encoder(ids)
        if lengths[0]:
            _run(coder, lengths, wide)
        for i, words in zip(order, coder.finish(), strict=True):
            crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
            out[i] = struct.pack(HEAD, len(blocks[i]) | (WIDE if wide else 0), len(words) // 2, crc, zlib.crc32(words)) + words
    return out


def decode_blocks(blocks: list[tuple[tuple[int, int, int, int], bytes]]) -> list[np.ndarray]:
    """(header fields, payload) of each block -> its ids; a damaged block raises ValueError."""
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    for head, words in blocks:
        if zlib.crc32(words) != head[3]:
            raise ValueError("damaged block")
    for wide in (False, True):
        own = [i for i, (head, _) in enumerate(blocks) if bool(head[0] & WIDE) == wide]
        for lo in range(0, len(own), LANES):
            order = sorted(own[lo:lo + LANES], key=lambda i: -(blocks[i][0][0] & ~WIDE))
            lengths = np.array([blocks[i][0][0] & ~WIDE for i in order])
            if lengths[0]:
                ids = np.ascontiguousarray(_run(_Decoder([blocks[i][1] for i in order]), lengths, wide).T.astype("<u4"))
                for r, i in enumerate(order):
                    out[i] = ids[r, :lengths[r]]
    for (head, _), ids in zip(blocks, out, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[2]:
            raise ValueError("damaged block")
    return out
