"""Operations on training corpora: cleaning, scoring, deduplication and encoding of documents."""
