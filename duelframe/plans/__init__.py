from duelframe.plans.comparison import Comparison, compare_files
from duelframe.plans.features import engineer
from duelframe.plans.scoring import score_matchups, score_upcoming
from duelframe.plans.training import TrainingResult, train

__all__ = ["Comparison", "TrainingResult", "compare_files", "engineer", "score_matchups", "score_upcoming", "train"]
