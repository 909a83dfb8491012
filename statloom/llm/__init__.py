"""Operations of a training-data pipeline: duplicates, tokens, fingerprints, mixing, quality, privacy, crawls."""
