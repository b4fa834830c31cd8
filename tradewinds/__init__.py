"""tradewinds: a PySpark engine for free-text trade markets and the corpora around them."""
