"""op8's ids come from one pass of the library over a text, and a text whose words never repeat costs no more than one."""

import random
import time

from docengine.llm import bpe, packing
from docengine.llm.queries import ranks


def test_new_words_cost_what_the_library_takes():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3000)) for _ in range(20)]
    enc, plain = packing.encoder(ranks()), bpe.codec(ranks())
    assert all(enc.encode(t)[0].tolist() == list(plain.encode(t)) for t in texts[:2])

    def seconds(encode):
        start = time.process_time()
        for t in texts:
            encode(t)
        return time.process_time() - start

    packing.encoder.cache_clear()
    fresh = packing.encoder(ranks())
    assert seconds(fresh.encode) < 1.5 * seconds(plain.encode)


def test_runs_of_blanks():
    text = "one" + " " * 300_000 + "two\n" + "\n" * 200_000
    ids, ends = packing.encoder(ranks()).encode(text)
    assert len(ids) and (ends > 0).all()
