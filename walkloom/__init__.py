"""walkloom: labelled graphs and other sequences to tokens, analysed with Spark."""
