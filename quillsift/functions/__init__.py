"""Column functions: text analysis, stemming, weighting."""
