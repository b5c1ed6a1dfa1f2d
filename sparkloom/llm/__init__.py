"""Operators for training-data pipelines, and the queries that apply them."""

from . import bpe, chat, forest, interpolated, kdtree, minhash, mixing, quality, suffix, warc

QUERIES = {
    "op1_kdtree": kdtree.op1_kdtree,
    "op2_warc": warc.op2_warc,
    "op3_forest": forest.op3_forest,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_interpolated_lm": interpolated.op7_interpolated_lm,
    "op8_suffix_array": suffix.op8_suffix_array,
    "op9_chat": chat.op9_chat,
    "op10_minhash": minhash.op10_minhash,
}
SQL = {"op1_kdtree": kdtree.OP1_SQL, "op3_forest": forest.OP3_SQL, "op2_warc": warc.OP2_SQL, "op8_suffix_array": suffix.OP8_SQL, "op9_chat": chat.OP9_SQL, "op10_minhash": minhash.OP10_SQL}
