"""Small awkward texts for the operators' tests."""

import random

ODD = [None, "", " ", "\n", "a", "'s", "x's 're 'LL ÉßΣςİ", "é̀ ﬁ 中文\U0001f600\U0001f600", "\n\n \n x\r\n\ty ",
       "<|endoftext|>a<|endoftext|><|startoftext|>", "1234567 ٣٤ ...!!", "a" * 700 + " " * 300 + "b c" * 40]


def awkward(n: int = 60, seed: int = 1) -> list:
    rnd = random.Random(seed)
    parts = [" ", "\n", "the", "The ", "'t", "é", "中", "\U0001f600", "12", "...", "word ", "  ", " ", "Ab"]
    return [*ODD, *("".join(rnd.choices(parts, k=rnd.randrange(60))) for _ in range(n)), "tie text", "tie text",
            "very long " * 20_000]
