"""Weak parts of credentials that overlap each other or are long."""

from __future__ import annotations

import re

import pytest

from tessera.llm import secrets

from .fixtures import frame

ROLE = {0: "key", 4: "key", 1: "id", 3: "id", 5: "endpoint"}
BASE = {0: secrets.ASSIGN, 1: secrets.ACCESS, 2: secrets.HEX}


def brute(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and weak spans each kind on its own with a complement in their scope."""
    found = [(m.start(), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if k or len(m[2]) >= 6]
    weak = [(m.start(), k, m.end()) for k, p in ((3, secrets.ID), (4, secrets.KEY), (5, secrets.ENDPOINT)) for m in re.finditer(f"(?i)(?:{p})", text)]
    parts = weak + [s for s in found if s[1] in ROLE]
    key = lambda s: ROLE[s[1]] == "key"
    near = lambda s, o: o[0] <= s[2] + secrets.SCOPE and o[2] >= s[0] - secrets.SCOPE
    return sorted(found + [s for s in weak if any(key(s) != key(o) and near(s, o) for o in parts)])


def check(spark, texts: list[str]) -> list[str]:
    docs = frame(spark, list(enumerate(texts)), repeated=False)
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute(t)), t[:80]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    return [masked[i] for i in range(len(texts))]


@pytest.mark.parametrize("key", ["pwd", "auth", "passphrase", "private_key", "access_key"])
def test_parts_within_an_address(spark, key):
    masked = check(spark, [f"go https://api.example.com/login?user=alice&{key}=hunter2hunter now", "https://api.example.com/login?user=alice", f"é user: auth=abcdefgh {key}: user=abcdefgh"])
    assert masked[0] == f"go {secrets.MASK} now" and masked[1].startswith("https")


@pytest.mark.parametrize("gap", [0, 199, 200, 201])
def test_long_complements_link_by_their_end(spark, gap):
    pad, long = " " * gap, "Z" * 600
    texts = [f"token={long}{pad}user: alice", f"user: alice{pad} token={long}", f"auth={long}{pad} user: alice", f"https://a.example.com/{long}{pad} pwd: hunter2hunter", f"é {pad}pwd: hunter2hunter{pad} user: {long}{pad} auth: abcdefgh"]
    masked = check(spark, texts)
    assert ("alice" in masked[0]) == (gap > 200)
