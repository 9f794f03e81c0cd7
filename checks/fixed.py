"""Values the queries and their SQL share."""

# The positive centroids of the fitted codebooks for dimension
# 64; the negative ones mirror them.
_POSITIVE = {
    1: [0.10012590841968],
    2: [0.05652817006200, 0.18752350006239],
    3: [0.03048994515394, 0.09388452079477, 0.16623513216118, 0.26397997417692],
    4: [0.01599832370401, 0.04830296406353, 0.08161535443931, 0.11684078920643,
        0.15529988085338, 0.19923149840322, 0.25326048031131, 0.33108044836882],
}
DIM = 64
CODEBOOK = {bits: [-c for c in reversed(half)] + half for bits, half in _POSITIVE.items()}

TOP_N = 10
SAMPLE_EVERY = 100
ROW_CAP = 500
INDEX_CAP = 120
# Dimension of the vectors that are padded to the next power of two.
PADDED = 96
# The questions the reference asks, and how many results it shows.
QUESTIONS = [(0, "What is the social impact of war?"), (1, "Retrieval Augmented Generation, RAG")]
CARDS = 12
# Cells of a laid out index, how many of them a quick search reads, and how far
# the vectors of a label are moved along an axis to form a group.
CELLS = 16
PROBES = 12
PUSH = 3.0
# One line of this many is spoiled, in each of three ways.
BROKEN_EVERY = 10
# Vectors that a step of k-means starts from.
CLUSTERS = 8
# Directions that a step of PCA multiplies, and buckets of tables laid out alike.
DIRECTIONS = 3
BUCKETS = 8
