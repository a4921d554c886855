"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from joblens.llm.alignment import op11_diagonal_run_skipping
from joblens.llm.exact_dedup import OP5_SQL, op5_chunk_recipes
from joblens.llm.fingerprints import op9_weighted_sampling
from joblens.llm.language import op4_string_kernel
from joblens.llm.line_dedup import op8_line_similarity_join
from joblens.llm.mixing import op6_hypergeometric_mixing
from joblens.llm.ngram_join import op10_lsh_forest_join
from joblens.llm.packing import op1_grouping_genetic_packing
from joblens.llm.private_spans import op12_semi_markov_field
from joblens.llm.ranked_search import OP13_SQL, op13_hashed_max_sketches
from joblens.llm.secrets import op3_trigram_index
from joblens.llm.sharding import op2_bounded_load_ring
from joblens.llm.warc import op7_dictionary_warc

QUERIES = {
    build.__name__: build
    for build in (
        op1_grouping_genetic_packing,
        op2_bounded_load_ring,
        op3_trigram_index,
        op4_string_kernel,
        op5_chunk_recipes,
        op6_hypergeometric_mixing,
        op7_dictionary_warc,
        op8_line_similarity_join,
        op9_weighted_sampling,
        op10_lsh_forest_join,
        op11_diagonal_run_skipping,
        op12_semi_markov_field,
        op13_hashed_max_sketches,
    )
}

SQL = {"op5_chunk_recipes": OP5_SQL, "op13_hashed_max_sketches": OP13_SQL}
