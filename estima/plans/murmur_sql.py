"""murmur3_128 of a bigint in DuckDB SQL: unsigned 128-bit products, taken modulo 2^64, step by step."""

from __future__ import annotations

_TWO64 = "18446744073709551616::UHUGEINT"


def _mul(x: str, factor: int) -> str:
    return f"(({x})::UHUGEINT * {factor}::UHUGEINT % {_TWO64})::UBIGINT"


def _add(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % {_TWO64})::UBIGINT"


def _rotl(x: str, r: int) -> str:
    return f"(((({x})::UHUGEINT * {1 << r}::UHUGEINT) % {_TWO64})::UBIGINT | (({x}) >> {64 - r}))"


def hashed(select: str, seed: int = 9001) -> str:
    """WITH ... hashed AS (the columns of select, which has a bigint v, and h1 and h2, both UBIGINT)."""
    steps = [
        ("m0", f"SELECT *, {_mul('(CASE WHEN v < 0 THEN (v::HUGEINT + 18446744073709551616)::UBIGINT ELSE v::UBIGINT END)', 0x87C37B91114253D5)} AS k1 FROM ({select})"),
        ("m1", f"SELECT * EXCLUDE (k1), {_mul(_rotl('k1', 31), 0x4CF5AD432745937F)} AS k1 FROM m0"),
        ("m2", f"SELECT * EXCLUDE (k1), xor(xor({seed}::UBIGINT, k1), 8::UBIGINT) AS a, xor({seed}::UBIGINT, 8::UBIGINT) AS b FROM m1"),
        ("m3", f"SELECT * EXCLUDE (a, b), {_add('a', 'b')} AS a, b FROM m2"),
        ("m4", f"SELECT * EXCLUDE (b), {_add('a', 'b')} AS b FROM m3"),
    ]
    for n, factor in ((5, 0xFF51AFD7ED558CCD), (6, 0xC4CEB9FE1A85EC53)):
        mixed = ", ".join(f"{_mul(f'xor({x}, {x} >> 33)', factor)} AS {x}" for x in "ab")
        steps.append((f"m{n}", f"SELECT * EXCLUDE (a, b), {mixed} FROM m{n - 1}"))
    steps += [
        ("m7", "SELECT * EXCLUDE (a, b), xor(a, a >> 33) AS a, xor(b, b >> 33) AS b FROM m6"),
        ("m8", f"SELECT * EXCLUDE (a), {_add('a', 'b')} AS h1 FROM m7"),
        ("hashed", f"SELECT * EXCLUDE (b), {_add('h1', 'b')} AS h2 FROM m8"),
    ]
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in steps)
