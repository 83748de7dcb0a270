"""Column functions: text cleaning, n-grams, HTML, stemming, edit distance."""
