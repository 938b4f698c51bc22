"""DataFrame operators: registry, coverage, identity, promotion, profiling, keys, evidence, privacy, ageing, recon."""
