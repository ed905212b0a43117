"""The standard security handler: keys from passwords, and strings and streams decrypted.

Revisions 2 to 4 use MD5 and RC4 or AES-128, 5 and 6 SHA-2 and AES-256. AES is built here from its
definition over GF(2^8); its tables are computed.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

from .values import Name, PdfError, Ref

# Fixed value: what short passwords are filled up with.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        a = s[i]
        j = j + a + k & 255
        s[i] = s[j]
        s[j] = a
    out, i, j = [], 0, 0
    for _ in range(len(data)):
        i = i + 1 & 255
        a = s[i]
        j = j + a & 255
        b = s[i] = s[j]
        s[j] = a
        out.append(s[a + b & 255])
    return (int.from_bytes(data) ^ int.from_bytes(bytes(out))).to_bytes(len(data))


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    forward = []
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        y = 0
        for k in range(5):
            y ^= (inverse << k | inverse >> 8 - k) & 255
        forward.append(y ^ 0x63)
    backward = [0] * 256
    for x, y in enumerate(forward):
        backward[y] = x
    return forward, backward


class Aes:
    """Blocks are columns of four bytes; many blocks are worked on together as arrays."""

    tables = columns = whole = None

    def __init__(self, key: bytes):
        import numpy as np

        if Aes.tables is None:
            forward, backward = _boxes()
            times = {m: np.array([_times(x, m) for x in range(256)], dtype=np.uint8) for m in (2, 3, 9, 11, 13, 14)}
            Aes.tables = np.array(forward, dtype=np.uint8), np.array(backward, dtype=np.uint8), times
        box = Aes.tables[0]
        n = len(key) // 4
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        constant = 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [int(box[b]) for b in w[1:] + w[:1]]
                w[0] ^= constant
                constant = _times(constant, 2)
            elif n > 6 and i % n == 4:
                w = [int(box[b]) for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = np.array(words, dtype=np.uint8).reshape(-1, 16)
        self.np = np
        # A round's substitution and mixing are four lookups of a column, whose bytes are one number.
        if Aes.columns is None:
            sub, back, times = Aes.tables
            one = np.arange(256, dtype=np.uint8)
            word = lambda box, factors, k: np.ascontiguousarray(np.stack([(times[f] if f > 1 else one)[box] for f in factors[-k:] + factors[:-k]], axis=1)).view(np.uint32).ravel()
            Aes.columns = tuple(tuple(word(box, factors, k) for k in range(4)) for box, factors in ((sub, (2, 1, 1, 3)), (back, (14, 9, 13, 11))))
            Aes.whole = tuple(t.view(">u4").tolist() for t in Aes.columns[0])

    #: Where each byte of a block comes from when its rows are shifted.
    SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
    BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]

    def _mix(self, x, factors):
        np, times = self.np, Aes.tables[2]
        c = x.reshape(-1, 4, 4)
        get = lambda m, v: v if m == 1 else times[m][v]
        rows = [np.bitwise_xor.reduce([get(factors[(k - r) % 4], c[:, :, k]) for k in range(4)]) for r in range(4)]
        return np.stack(rows, axis=2).reshape(-1, 16)

    def _round(self, x, columns, places):
        a, b, c, d = (t[x[:, places[k::4]]] for k, t in enumerate(columns))
        return self.np.ascontiguousarray(a ^ b ^ c ^ d).view(self.np.uint8).reshape(-1, 16)

    def encrypt_blocks(self, data: bytes) -> bytes:
        x = self.np.frombuffer(data, dtype=self.np.uint8).reshape(-1, 16) ^ self.keys[0]
        for k in self.keys[1:-1]:
            x = self._round(x, Aes.columns[0], self.SHIFT) ^ k
        return (Aes.tables[0][x][:, self.SHIFT] ^ self.keys[-1]).tobytes()

    def decrypt_blocks(self, data: bytes) -> bytes:
        x = self.np.frombuffer(data, dtype=self.np.uint8).reshape(-1, 16) ^ self.keys[-1]
        for k in self._mix(self.keys[1:-1], (14, 11, 13, 9))[::-1]:
            x = self._round(x, Aes.columns[1], self.BACK) ^ k
        return (Aes.tables[1][x[:, self.BACK]] ^ self.keys[0]).tobytes()

    def cbc_encrypt(self, iv: bytes, data: bytes) -> bytes:
        # Each block needs the one before, so one is worked on at a time, as four numbers.
        t0, t1, t2, t3 = Aes.whole
        first, *middle, final = [struct.unpack(">4I", bytes(k)) for k in self.keys]
        box, out = bytes(Aes.tables[0]), []
        e, f, g, h = struct.unpack(">4I", iv)
        p, q, r, s = first
        u, v, w, z = final
        for a, b, c, d in struct.iter_unpack(">4I", data):
            a, b, c, d = a ^ e ^ p, b ^ f ^ q, c ^ g ^ r, d ^ h ^ s
            for k, m, n, o in middle:
                a, b, c, d = (
                    t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k,
                    t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ m,
                    t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ n,
                    t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ o,
                )
            e = (box[a >> 24] << 24 | box[b >> 16 & 255] << 16 | box[c >> 8 & 255] << 8 | box[d & 255]) ^ u
            f = (box[b >> 24] << 24 | box[c >> 16 & 255] << 16 | box[d >> 8 & 255] << 8 | box[a & 255]) ^ v
            g = (box[c >> 24] << 24 | box[d >> 16 & 255] << 16 | box[a >> 8 & 255] << 8 | box[b & 255]) ^ w
            h = (box[d >> 24] << 24 | box[a >> 16 & 255] << 16 | box[b >> 8 & 255] << 8 | box[c & 255]) ^ z
            out += (e, f, g, h)
        return struct.pack(f">{len(out)}I", *out)

    def cbc_decrypt(self, iv: bytes, data: bytes) -> bytes:
        np = self.np
        plain = np.frombuffer(self.decrypt_blocks(data), dtype=np.uint8)
        return (plain ^ np.frombuffer((iv + data)[: len(data)], dtype=np.uint8)).tobytes()


def aes_open(key: bytes, data: bytes) -> bytes:
    """Initial vector, then blocks, the last one padded with the padding's length."""
    body = data[16:]
    if len(data) < 16 or len(body) % 16:
        raise PdfError("encrypted bytes of a wrong length")
    if not body:
        return b""
    plain = Aes(key).cbc_decrypt(data[:16], body)
    n = plain[-1]
    return plain[:-n] if 1 <= n <= 16 and plain.endswith(bytes([n]) * n) else plain


def hardened(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    """The password hash of revision 5 (plain) and 6 (at least 64 rounds of AES and SHA-2)."""
    k = hashlib.sha256(password + salt + extra).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = Aes(k[:16]).cbc_encrypt(k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


@lru_cache(1024)
def user_password(owner: bytes, entry: bytes, revision: int, size: int) -> bytes:
    """The user's password that an owner's one finds in /O; documents locked with the same passwords have the same /O."""
    k = hashlib.md5((owner + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        k = hashlib.md5(k).digest()
    for i in reversed(range(20 if revision >= 3 else 1)):
        entry = rc4(bytes(b ^ i for b in k[:size]), entry)
    return entry


class Security:
    """The file key for one of the passwords (the empty one is tried first), and who it belongs to."""

    def __init__(self, items, file_id: bytes, passwords: tuple[str, ...], resolve):
        if not isinstance(items, dict):
            raise PdfError("encryption dictionary is missing", "encryption-dictionary-invalid")
        get = lambda k, d=None: d if (v := resolve(items.get(k))) is None else v
        if get("Filter") != "Standard":
            raise PdfError("unknown security handler", "encryption-handler-unsupported")
        self.version, self.revision = get("V", 0), get("R")
        if self.version not in (1, 2, 4, 5) or self.revision not in (2, 3, 4, 5, 6):
            raise PdfError("unknown encryption revision", "encryption-handler-unsupported")
        self.o, self.u, self.p = get("O"), get("U"), get("P")
        if not isinstance(self.o, bytes) or not isinstance(self.u, bytes) or not isinstance(self.p, int):
            raise PdfError("encryption dictionary is incomplete", "encryption-dictionary-invalid")
        self.own: Ref | None = None
        self.size = 5 if self.version == 1 else 32 if self.version == 5 else get("Length", 128 if self.version == 4 else 40) // 8
        self.metadata = get("EncryptMetadata", True) is not False
        crypt = {k: resolve(v) for k, v in (get("CF", {}) or {}).items()}

        def method(name):
            name = get(name, Name("Identity"))
            return "Identity" if name == "Identity" else str((crypt.get(name) or {}).get("CFM", "None"))

        self.for_strings, self.for_streams = (method("StrF"), method("StmF")) if self.version >= 4 else ("V2", "V2")
        self.file_id, self.items, self.get = file_id, items, get
        self.credential = ""
        for password in ("", *passwords[:3]):
            raw = password.encode("utf-8")[:127] if self.version == 5 else password.encode("latin-1", "replace")
            if (found := self._modern(raw) if self.version == 5 else self._legacy(raw)) is not None:
                self.key, self.credential = found
                break
        else:
            raise PdfError("no password opens the document", "password-invalid" if passwords else "password-required")

    def _legacy_key(self, password: bytes) -> bytes:
        h = hashlib.md5((password + PADDING)[:32] + self.o[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + self.file_id)
        if self.revision >= 4 and not self.metadata:
            h.update(b"\xff\xff\xff\xff")
        k = h.digest()[: self.size]
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k).digest()[: self.size]
        return k

    def _legacy_mark(self, key: bytes) -> bytes:
        if self.revision == 2:
            return rc4(key, PADDING)
        x = hashlib.md5(PADDING + self.file_id).digest()
        for i in range(20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x

    def _legacy(self, password: bytes):
        def opens(p):
            key = self._legacy_key(p)
            mark = self._legacy_mark(key)
            return key if self.u[: len(mark)] == mark else None

        if key := opens(password):
            return key, "user"
        return (key, "owner") if (key := opens(user_password(password, self.o[:32], self.revision, self.size))) else None

    def _modern(self, password: bytes):
        for who, entry, wrapped, extra in (("owner", self.o, self.get("OE"), self.u[:48]), ("user", self.u, self.get("UE"), b"")):
            if isinstance(wrapped, bytes) and hardened(password, entry[32:40], extra, self.revision) == entry[:32]:
                key = Aes(hardened(password, entry[40:48], extra, self.revision)).cbc_decrypt(bytes(16), wrapped[:32])
                perms = self.get("Perms")
                if isinstance(perms, bytes) and len(perms) >= 16:
                    plain = Aes(key).decrypt_blocks(perms[:16])
                    if plain[9:12] != b"adb" or plain[:4] != (self.p & 0xFFFFFFFF).to_bytes(4, "little"):
                        raise PdfError("permissions do not fit the key", "encryption-dictionary-invalid")
                return key, who
        return None

    def _open(self, method: str, data: bytes, ref: Ref) -> bytes:
        if method in ("Identity", "None"):
            return data
        if method == "AESV3":
            return aes_open(self.key, data)
        k = self.key + ref.obj.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")
        k = hashlib.md5(k).digest()[: min(16, len(self.key) + 5)]
        return aes_open(k, data) if method == "AESV2" else rc4(k, data)

    def string(self, data: bytes, ref: Ref) -> bytes:
        return self._open(self.for_strings, data, ref)

    def stream(self, data: bytes, ref: Ref, items: dict) -> bytes:
        first = items.get("Filter")
        first = first[0] if isinstance(first, list) and first else first
        return data if first == "Crypt" else self._open(self.for_streams, data, ref)


#: Bits (from 1) of P and what they permit.
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11, "print_high": 12}


def permissions(p: int, credential: str) -> dict[str, bool]:
    """An owner may all; a user what the bits say."""
    return {k: credential in ("none", "owner") or bool(p >> bit - 1 & 1) for k, bit in PERMISSIONS.items()}
