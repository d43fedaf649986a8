"""Token counts against the library."""

from granary.llm import token_counts


def test_token_counts_as_the_library(awkward_docs, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    out = token_counts.count_tokens(awkward_docs).collect()
    expected = sorted((len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward)
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
