"""Operations of a training-data pipeline: corpus statistics, duplicates, tokens, leakage, repair."""
