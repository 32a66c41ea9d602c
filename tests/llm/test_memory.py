"""An operator that works drops what the others remember."""
from ledgerline.llm import memory


def test_claim(monkeypatch):
    monkeypatch.setattr(memory, "_release", {})
    monkeypatch.setattr(memory, "_owner", [])
    a, b = {1: 1}, {2: 2}
    memory.claim("a", a.clear)
    memory.claim("b", b.clear)
    assert not a and b
    memory.claim("b", b.clear)
    assert b
    memory.claim("a", a.clear)
    assert not b
