"""SQL that the oracles share."""


def crc32(x: str) -> str:
    """The unsigned CRC-32 of an ASCII string expression, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"
    codes = f"list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::int, 1))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {bits}), 4294967295)"
