"""op7: bits are put together and literals looked up without a number for each bit or pixel; results stay."""

import numpy as np
import pytest

from corpusloom.llm import webp


def plain_bytes(values, sizes):
    bits = "".join(f"{v & (1 << n) - 1:0{n}b}"[::-1] if n else "" for v, n in zip(values, sizes))
    return bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("most", [1, 7, 15, 28])
def test_bits_are_written_in_lanes(monkeypatch, most):
    rng = np.random.default_rng(most)
    sizes = rng.integers(0, most + 1, 4001)
    values = rng.integers(0, 1 << 28, 4001) & (1 << sizes) - 1
    w = webp.Writer()
    w.write(5, 3)
    w.extend(values, sizes)
    w.write(1, 1)
    # No array has an entry for each bit.
    monkeypatch.setattr(np, "packbits", None)
    assert w.bytes() == plain_bytes([5, *values.tolist(), 1], [3, *sizes.tolist(), 1])
    assert webp.Writer().bytes() == b""


@pytest.mark.parametrize("payload", [bytes(range(256)) * 3, b"ab" * 5000, bytes(64), bytes(np.random.default_rng(1).integers(0, 60, 200_000, np.uint8)), b"x" * 70 + bytes(range(40)) * 90])
@pytest.mark.parametrize("cache_bits", [0, 4])
def test_stretches_of_literals_and_copies_come_back(payload, cache_bits):
    samples = np.frombuffer(payload + bytes(-len(payload) % 64), np.uint8).astype(np.int64)
    for argb in (webp.OPAQUE | samples << 8, samples << 24 | samples[::-1] << 16 | samples << 8 | 7, webp.OPAQUE | samples << 16):
        assert (webp.decode(webp.encode(argb, 64, len(argb) // 64, (), cache_bits))[2] == argb).all()
