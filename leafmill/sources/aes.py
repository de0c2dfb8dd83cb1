"""AES in CBC mode (FIPS 197), from its definition; small and plain, for keys and short documents."""

from __future__ import annotations

import struct


def _tables() -> tuple[bytes, list[list[int]]]:
    """The substitution box, from inverses in GF(2^8), and the four round tables over it."""
    box, p, q = bytearray(256), 1, 1
    while True:  # p runs over the powers of 3, q over those of its inverse
        p ^= (p << 1) ^ (0x11B if p & 0x80 else 0)
        p &= 0xFF
        for shift in (1, 2, 4):
            q ^= (q << shift) & 0xFF
        q ^= 0x09 if q & 0x80 else 0
        box[p] = 0x63 ^ q ^ ((q << 1 | q >> 7) & 0xFF) ^ ((q << 2 | q >> 6) & 0xFF) ^ ((q << 3 | q >> 5) & 0xFF) ^ ((q << 4 | q >> 4) & 0xFF)
        if p == 1:
            break
    box[0] = 0x63
    first = []
    for s in box:
        double = (s << 1) ^ (0x11B if s & 0x80 else 0)
        first.append(double << 24 | s << 16 | s << 8 | double ^ s)
    rounds = [first]
    for _ in range(3):
        rounds.append([(w >> 8) | (w & 0xFF) << 24 for w in rounds[-1]])
    return bytes(box), rounds


_BOX, _ROUNDS = _tables()
_INVERSE = bytes(_BOX.index(i) for i in range(256))


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


_BACK = [[_times(x, f) for x in range(256)] for f in (14, 11, 13, 9)]


def _schedule(key: bytes) -> list[int]:
    n = len(key) // 4
    words, factor = list(struct.unpack(f">{n}I", key)), 1
    sub = lambda w: int.from_bytes(bytes(_BOX[b] for b in w.to_bytes(4, "big")), "big")
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = sub((w << 8 | w >> 24) & 0xFFFFFFFF) ^ factor << 24
            factor = _times(factor, 2)
        elif n > 6 and i % n == 4:
            w = sub(w)
        words.append(words[i - n] ^ w)
    return words


def _encrypted(block: tuple[int, ...], words: list[int]) -> tuple[int, ...]:
    t0, t1, t2, t3 = _ROUNDS
    a, b, c, d = (x ^ w for x, w in zip(block, words))
    last = len(words) - 4
    for i in range(4, last, 4):
        a, b, c, d = (
            t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ words[i],
            t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ words[i + 1],
            t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ words[i + 2],
            t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ words[i + 3],
        )
    state, s = (a, b, c, d), _BOX
    return tuple((s[state[k] >> 24] << 24 | s[state[(k + 1) % 4] >> 16 & 255] << 16 | s[state[(k + 2) % 4] >> 8 & 255] << 8 | s[state[(k + 3) % 4] & 255]) ^ words[last + k] for k in range(4))


def _decrypted(block: bytes, words: list[int]) -> bytes:
    keys = [struct.pack(">4I", *words[i : i + 4]) for i in range(0, len(words), 4)]
    state = bytes(x ^ k for x, k in zip(block, keys[-1]))
    e, b, d, n = _BACK
    for key in reversed(keys[:-1]):
        state = bytes(_INVERSE[state[(i - 4 * (i % 4)) % 16]] ^ key[i] for i in range(16))
        if key is not keys[0]:
            state = b"".join(bytes((e[w] ^ b[x] ^ d[y] ^ n[z], n[w] ^ e[x] ^ b[y] ^ d[z], d[w] ^ n[x] ^ e[y] ^ b[z], b[w] ^ d[x] ^ n[y] ^ e[z])) for w, x, y, z in (state[i : i + 4] for i in range(0, 16, 4)))
    return state


def encrypt_cbc(key: bytes, iv: bytes, data: bytes, *, pad: bool = True) -> bytes:
    if pad:
        data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    words, held, out = _schedule(key), struct.unpack(">4I", iv), []
    for block in struct.iter_unpack(">4I", data):
        held = _encrypted(tuple(x ^ y for x, y in zip(block, held)), words)
        out.append(struct.pack(">4I", *held))
    return b"".join(out)


def decrypt_cbc(key: bytes, iv: bytes, data: bytes, *, pad: bool = True) -> bytes:
    words = _schedule(key)
    blocks = [iv, *(data[i : i + 16] for i in range(0, len(data) // 16 * 16, 16))]
    out = b"".join(bytes(x ^ y for x, y in zip(_decrypted(now, words), before)) for before, now in zip(blocks, blocks[1:]))
    if pad and out:
        if not 1 <= out[-1] <= 16 or out[-out[-1] :] != bytes([out[-1]]) * out[-1]:
            raise ValueError("wrong padding")
        out = out[: -out[-1]]
    return out
