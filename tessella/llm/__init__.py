"""Training-data operators: thirteen corpus-scale jobs over documents and embeddings.

Nothing outside this subpackage imports it.  ``tessella.llm.queries`` registers one
``opN_<name>`` query per operator.
"""
