import os

# Before numpy is loaded: the small matrices of the tagger only lose by threads.
os.environ.setdefault("OMP_NUM_THREADS", "1")
