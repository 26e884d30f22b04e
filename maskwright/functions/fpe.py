"""FF1 format-preserving encryption of digit strings (NIST SP 800-38G), radix 10, AES.

A small AES encryptor is included because FF1 needs single blocks; it runs in an Arrow UDF over distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _times2(a: int) -> int:
    a <<= 1
    return (a ^ 0x11B) & 0xFF if a & 0x100 else a


def _sbox() -> list[int]:
    """Inverse in GF(2^8), then the affine map."""
    log, exp, x = {}, [], 1
    for i in range(255):
        exp.append(x)
        log[x] = i
        x ^= _times2(x)
    out = []
    for v in range(256):
        b = exp[(255 - log[v]) % 255] if v else 0
        out.append(b ^ ((b << 1 | b >> 7) & 255) ^ ((b << 2 | b >> 6) & 255) ^ ((b << 3 | b >> 5) & 255) ^ ((b << 4 | b >> 4) & 255) ^ 0x63)
    return out


SBOX = _sbox()


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        w = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        rcon = 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = list(w[-1])
            if i % n == 0:
                t = [SBOX[b] for b in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = _times2(rcon)
            elif n > 6 and i % n == 4:
                t = [SBOX[b] for b in t]
            w.append([a ^ b for a, b in zip(w[i - n], t)])
        self.keys = [sum(w[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def block(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                mixed = []
                for c in range(0, 16, 4):
                    col = s[c : c + 4]
                    every = col[0] ^ col[1] ^ col[2] ^ col[3]
                    mixed += [col[k] ^ every ^ _times2(col[k] ^ col[(k + 1) % 4]) for k in range(4)]
                s = mixed
            s = [a ^ b for a, b in zip(s, self.keys[r])]
        return bytes(s)


def ff1_encrypt(key: bytes, numerals: str, tweak: bytes = b"") -> str:
    """FF1.Encrypt for radix 10."""
    aes, n = Aes(key), len(numerals)
    u = n // 2
    v = n - u
    a, b = numerals[:u], numerals[u:]
    width = -(-(10**v - 1).bit_length() // 8)
    d = 4 * -(-width // 4) + 4
    p = bytes([1, 2, 1, 0, 0, 10, 10, u % 256]) + n.to_bytes(4, "big") + len(tweak).to_bytes(4, "big")
    for i in range(10):
        q = tweak + bytes((-len(tweak) - width - 1) % 16) + bytes([i]) + int(b).to_bytes(width, "big")
        r = bytes(16)
        for k in range(0, len(p + q), 16):
            r = aes.block(bytes(x ^ y for x, y in zip(r, (p + q)[k : k + 16])))
        s = r
        for j in range(1, -(-d // 16)):
            s += aes.block(bytes(x ^ y for x, y in zip(r, j.to_bytes(16, "big"))))
        m = u if i % 2 == 0 else v
        c = str((int(a) + int.from_bytes(s[:d], "big")) % 10**m).zfill(m)
        a, b = b, c
    return a + b


def enciphered(value: str | None, key: bytes) -> str | None:
    """FF1 over the digits of a value (separators go): '0' without digits, null with fewer than 7."""
    if value is None:
        return None
    d = "".join(ch for ch in value if "0" <= ch <= "9")
    return "0" if not d else None if len(d) < 7 else ff1_encrypt(key, d)


def fpe_numeric(c: Column, key: bytes = bytes(32)) -> Column:
    """enciphered() of a column, each distinct value of a batch once; null leaves it to the caller's fallback. An Arrow UDF: AES of single
    blocks has no built-in expression."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(values):
        known = {v: enciphered(v, key) for v in values.unique()}
        return values.map(known)

    return run(c)
