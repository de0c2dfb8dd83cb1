"""Protected PDF files: AES-256 with passwords (the standard handler's revision 6)."""

from __future__ import annotations

import hashlib
import os

from leafmill.sources import pdf
from leafmill.sources.aes import decrypt_cbc, encrypt_cbc
from leafmill.sources.pdf import Document, Name, Ref, Stream

#: The bits of what a reader may do.
PERMISSIONS = {"print": 1 << 2 | 1 << 11, "modify": 1 << 3 | 1 << 10, "copy": 1 << 4 | 1 << 9, "annotate": 1 << 5 | 1 << 8}
_NONE = bytes(16)


class WrongPassword(pdf.Encrypted):
    pass


def _hash(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The handler's slow hash of a password."""
    held, n = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        mixed = encrypt_cbc(held[:16], held[16:32], (password + held + user) * 64, pad=False)
        held = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(mixed[:16]) % 3](mixed).digest()
        n += 1
        if n >= 64 and mixed[-1] <= n - 32:
            return held[:32]


def _walked(value, text, data, skip: Ref | None):
    """The value with strings and stream data changed."""
    if isinstance(value, bytes):
        return text(value)
    if isinstance(value, list):
        return [_walked(v, text, data, skip) for v in value]
    if isinstance(value, dict):
        return {k: _walked(v, text, data, skip) for k, v in value.items()}
    if isinstance(value, Stream):
        if value.entries.get("Type") == "XRef":
            return value
        return Stream(_walked(value.entries, text, data, skip), data(value.raw))
    return value


def protect(doc: Document, user: str = "", owner: str = "", allowed: tuple[str, ...] = ()) -> bytes:
    """The file encrypted; without a password for the owner, one is drawn, and nobody can lift the restrictions."""
    if not user and not owner and set(allowed) >= set(PERMISSIONS):
        raise ValueError("neither a password nor a restriction")
    key = os.urandom(32)
    secret, master = user.encode()[:127], (owner.encode() or os.urandom(16).hex().encode())[:127]
    salts = [os.urandom(8) for _ in range(4)]
    u = _hash(secret, salts[0]) + salts[0] + salts[1]
    o = _hash(master, salts[2], u) + salts[2] + salts[3]
    bits = -(1 << 32) | 0xFFFFF0C0 | sum(PERMISSIONS[a] for a in allowed)
    perms = (bits & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + os.urandom(4)
    entries = {
        "Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": bits, "U": u, "O": o,
        "UE": encrypt_cbc(_hash(secret, salts[1]), _NONE, key, pad=False), "OE": encrypt_cbc(_hash(master, salts[3], u), _NONE, key, pad=False),
        "Perms": encrypt_cbc(key, _NONE, perms, pad=False), "StmF": Name("StdCF"), "StrF": Name("StdCF"), "EncryptMetadata": True,
        "CF": {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}},
    }

    def sealed(raw: bytes) -> bytes:
        iv = os.urandom(16)
        return iv + encrypt_cbc(key, iv, raw)

    plain = pdf.load(pdf.save(doc))
    plain.objects = {n: _walked(v, sealed, sealed, None) for n, v in plain.objects.items()}
    plain.version = max(plain.version, "1.7")
    return pdf.save(plain, {"Encrypt": entries, "ID": [os.urandom(16)] * 2})


def unlock(raw: bytes, password: str = "") -> Document:
    """The document in plain; a file that is not encrypted is an error, and so is a wrong password."""
    doc = pdf.load(raw, encrypted=True)
    entries = doc.get(doc.trailer.get("Encrypt"))
    if not isinstance(entries, dict):
        raise pdf.Unreadable("the file is not encrypted")
    entries = {k: doc.get(v) for k, v in entries.items()}
    if entries.get("V") != 5 or entries.get("R") != 6:
        raise pdf.Encrypted("another kind of encryption")
    u, o, secret = entries["U"][:48], entries["O"][:48], password.encode()[:127]
    if _hash(secret, u[32:40]) == u[:32]:
        key = decrypt_cbc(_hash(secret, u[40:48]), _NONE, entries["UE"][:32], pad=False)
    elif _hash(secret, o[32:40], u) == o[:32]:
        key = decrypt_cbc(_hash(secret, o[40:48], u), _NONE, entries["OE"][:32], pad=False)
    else:
        raise WrongPassword("a password is needed" if not password else "the password is wrong")
    opened = lambda data: decrypt_cbc(key, data[:16], data[16:]) if len(data) >= 32 else b""
    held = doc.trailer["Encrypt"]
    doc.objects = {n: v if isinstance(held, Ref) and n == held.number else _walked(v, opened, opened, None) for n, v in doc.objects.items()}
    doc.trailer = {k: v for k, v in doc.trailer.items() if k not in ("Encrypt", "ID")}
    pdf.unpack(doc)
    return doc
