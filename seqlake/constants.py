"""Fixed values that results depend on.

FIXED VALUES -- these must stay equal to the behaviour being reproduced; do not change them
to make a result look different.
"""

# Token id used for padding; positions holding it are dropped before any loss.
PAD_ID = 4

# Classes kept for the losses, in this order: PAD (stands for N), T, G, C, A.
USEFUL_CLASSES = (4, 10, 9, 8, 7)
POSITION_BLOCK = 4096      # positions per row of a soft-label store (M6)

# Length of one interval ("segment"); tiles must divide it.
MAX_ALLOWED_LENGTH = 2 ** 17

# Sample indices replaced at read time by default.
DEFAULT_SKIP = (8590,)

# Epsilon added to each squared norm by the cosine embedding loss.
COSINE_EPS = 1e-12

# Epsilon in the update ratio of the parameter statistics.
UPDATE_RATIO_EPS = 1e-8

# Parameter-name suffixes that get per-layer statistics, and the embedding marker.
SIGNIFICANT_PARAM_SUFFIXES = (
    "mamba_fwd.in_proj.weight",
    "mamba_fwd.out_proj.weight",
    "mamba_fwd.x_proj.weight",
    "mamba_fwd.dt_proj.weight",
    "mamba_rev.x_proj.weight",
    "mamba_rev.dt_proj.weight",
)
EMBEDDING_PARAM_MARKER = "word_embeddings.embedding.weight"
SUBMODULE_PREFIX = "mixer.submodule."

# The six metrics reported per (task, model, split), in report order.
RESULT_METRICS = ("roc_auc", "mcc", "accuracy", "f1", "n_samples", "n_positive")

# Metrics copied into the training log after a probe evaluation.
HEADLINE_METRICS = ("roc_auc", "f1")

# Default nucleotide vocabulary (our design: the real one is a downloaded tokenizer).
# Input is folded to upper case first; every other character gets OTHER_ID.
DEFAULT_VOCAB = {"A": 7, "C": 8, "G": 9, "T": 10, "N": 11}
OTHER_ID = 6

# Seeded replacement index for skipped samples: pmod(idx * A + C, n).
LCG_A = 1103515245
LCG_C = 12345

# Checkpoint file-name template: epoch two digits, loss three decimals, step.
CHECKPOINT_TEMPLATE = "student__epoch=%02d__val_loss_total=%.3f__step=%d"
