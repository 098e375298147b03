"""Search, maintenance, shaping and evaluation over tables of vectors."""
