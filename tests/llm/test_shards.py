"""A shard of collocations is gone with its last reference: nothing of it waits for the collector."""

import gc

from maskwright.llm import collocations


def test_shards_hold_no_cycle():
    gc.collect()
    gc.disable()
    try:
        shard = collocations._Shard()
        shard.add(b"one two, one")
        assert shard.words().tolist() == [2, 3, 0, 2, 0]
        del shard
        assert gc.collect() == 0
    finally:
        gc.enable()
