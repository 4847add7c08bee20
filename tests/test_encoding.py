from hypothesis import given
from hypothesis import strategies as st

from gramlode.functions import encoding as e


@given(st.lists(st.integers(0, 2**40)))
def test_varint_round_trip(values):
    assert list(e.unvarint(e.varint(values))) == values


@given(st.sets(st.integers(0, 2**32 - 1)))
def test_delta_round_trip(fids):
    assert e.undelta(e.deltas(sorted(fids))) == sorted(fids)


def test_varint_bytes():
    assert e.varint([0, 127, 128, 300]) == bytes([0, 127, 0x80, 1, 0xAC, 2])


def test_grams():
    assert e.grams("abcde") == {e.gram_key(b"abcd"), e.gram_key(b"bcde")}
    assert e.grams(b"abc") == set()
    assert e.gram_key(b"\x01\x00\x00\x02") == 0x01000002


def test_widen_and_case():
    assert e.widen(b"ab") == b"a\0b\0"
    assert e.case_variants(b"a1B") == {b"a1b", b"a1B", b"A1b", b"A1B"}
    assert e.case_variants(b"\x01\xe9") == {b"\x01\xe9"}


def test_primes():
    assert [len(e.build_primes(w)) for w in range(8, 17)] == [12, 22, 39, 70, 125, 227, 256, 256, 256]
    assert e.build_primes(8)[0] == 191 and e.build_primes(14)[0] == 13913 and e.build_primes(16)[0] == 62627
    for w in range(11, 23):
        found = e.query_primes(w)
        assert len(found) == 256 and list(found) == sorted(found) and all(map(e.prime, found)) and found[-1] < 1 << w
    assert [n for n in range(30) if e.prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
