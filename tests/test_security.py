import pytest

from leafmill.sources import aes, pdf, pdf_security
from tests.test_merge import linked


def test_cipher_against_published_vectors():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, wanted in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        made = aes.encrypt_cbc(bytes(range(size)), bytes(16), block, pad=False)
        assert made.hex() == wanted and aes.decrypt_cbc(bytes(range(size)), bytes(16), made, pad=False) == block
    for n in (0, 1, 15, 16, 33):
        sealed = aes.encrypt_cbc(bytes(32), bytes(range(16)), b"x" * n)
        assert aes.decrypt_cbc(bytes(32), bytes(range(16)), sealed) == b"x" * n


def test_protected_files_open_with_either_password():
    raw = pdf_security.protect(pdf.set_info(linked("secret text"), {"Title": "T"}), "user", "owner", ("print",))
    assert b"secret" not in raw
    with pytest.raises(pdf.Encrypted):
        pdf.load(raw)
    for password in ("user", "owner"):
        doc = pdf.load(pdf.save(pdf_security.unlock(raw, password)))
        assert [r["text"] for r in pdf.page_rows(doc)] == ["secret text"] and pdf.string_text(doc.info()["Title"]) == "T"
    for password in ("", "wrong"):
        with pytest.raises(pdf_security.WrongPassword):
            pdf_security.unlock(raw, password)
    with pytest.raises(pdf.Unreadable):
        pdf_security.unlock(pdf.save(pdf.from_text("x")))
    with pytest.raises(ValueError):
        pdf_security.protect(pdf.from_text("x"), allowed=tuple(pdf_security.PERMISSIONS))
