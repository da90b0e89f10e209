"""The queries of this subpackage for __spark_entry__.py, and their SQL."""

from __future__ import annotations

from . import bytebpe, collocations, cotraining, knn, langid, lines, mixing, mjpeg, packing, pq, simhash, tokencount, warc

QUERIES = {
    "op1_voronoi_knn": knn.op1_voronoi_knn,
    "op2_warc_writer": warc.op2_warc_writer,
    "op3_cotraining": cotraining.op3_cotraining,
    "op4_line_site_spread": lines.op4_line_site_spread,
    "op5_trie_token_counts": tokencount.op5_trie_token_counts,
    "op6_simhash": simhash.op6_simhash,
    "op7_avi_mjpeg": mjpeg.op7_avi_mjpeg,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_systematic_mixing": mixing.op9_systematic_mixing,
    "op10_crf_langid": langid.op10_crf_langid,
    "op11_collocations": collocations.op11_collocations,
    "op12_byte_bpe": bytebpe.op12_byte_bpe,
    "op13_elkan_codes": pq.op13_elkan_codes,
}
ORACLES = {
    "op1_voronoi_knn": knn.OP1_SQL,
    "op2_warc_writer": warc.OP2_SQL,
    "op4_line_site_spread": lines.OP4_SQL,
    "op9_systematic_mixing": mixing.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_elkan_codes": pq.OP13_SQL,
}
