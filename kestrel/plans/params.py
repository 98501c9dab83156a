"""Settings of the registered queries, shared by the Spark plans and the SQL oracles."""

# Count-window jobs as the reference's run scripts call them.
WINDOW = 50            # rows per count window
STEP = 0.05            # step length
ITERATIONS = 50        # iterations per window
RIDGE_REG = 0.01       # effective ridge lambda
LASSO_REG = 0.1        # effective lasso lambda
LASSO_EPS = 0.01       # Huber epsilon
LOGISTIC_REG = 0.1     # L2 term of the logistic rule

# power of ten that the small-scale query multiplies its features by
SMALL_SCALE = -11

# Streaming SGD defaults (step, iterations), explicit lambdas.
SGD_STEP = 0.1
SGD_ITERATIONS = 50
SGD_L1_REG = 0.1
SGD_L2_REG = 0.1
SAMPLE_FRACTION = 0.5
# arithmetic row-hash for the sampled query: ((seq * A + t * B) mod M) / M < fraction
HASH_A, HASH_B, HASH_M = 7919, 104729, 1000

# windows that no single task holds: rows of one, and rows that a task may hold
LARGE_WINDOW, LARGE_SHARE = 4000, 1000

POINTS_DIM = 3         # two features + bias
TEXT_D = 2             # features per text line
ARITY_LENGTH = 3       # length guard of the arity query: a label alone is too short
WIDE_DIM = 65          # 64 embedding values + bias

# ALS settings of the registered queries (the operator defaults are the reference's
# rank 200 / 50 iterations; the registered queries use a small model).
ALS_RANK = 10
ALS_ITER = 10
ALS_REG = 0.1
# a user's factor solves its equation when the relative residual (of single-precision factors) is below this
ALS_RESIDUAL = 1e-5
UNION_YEAR = 1997      # the history and the later interval of the union query meet here
