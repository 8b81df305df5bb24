"""Names of stored artefacts: a table by its name, with the data set and parameters as partition columns."""

from __future__ import annotations

from dataclasses import dataclass

# Artefacts and the columns that tell their parts apart.
ARTEFACTS = {
    "question_texts": ("dataset",), "answer_texts": ("dataset",), "accepted_answer_ids": ("dataset",), "dup_pairs": ("dataset",), "corpus": ("dataset",), "corpus_tokenized": ("dataset",),
    "all_question_ids": ("dataset",), "duplicate_question_ids": ("dataset",), "main_question_ids": ("dataset",), "answered_question_ids": ("dataset",), "comparison_question_ids": ("dataset",), "noise_question_ids": ("dataset",), "train_dup_ids": ("dataset",), "test_dup_ids": ("dataset",),
    "embedding": ("dataset", "model", "col"), "feature_model": ("dataset", "model", "col"), "pair_ranks": ("dataset", "feature", "col"), "all_pair_ranks": ("dataset",),
    "candidate_pairs": ("dataset",), "train_candidate_pairs": ("dataset", "n", "perc"), "test_candidate_pairs": ("dataset", "n"), "feature": ("dataset", "feature"), "train_set": ("dataset", "n", "perc"), "test_set": ("dataset", "n"),
    "cv_results": ("dataset", "n", "perc"), "classifier": ("dataset", "n", "perc"), "candidates_evaluation": (), "cross_dataset_performance": (), "misclassified_duplicates": ("dataset",),
}


@dataclass(frozen=True)
class Catalog:
    root: str

    def path(self, artefact: str, **parts) -> str:
        """The folder of an artefact, or of a part of it, by the names that Spark gives partitions."""
        columns = ARTEFACTS[artefact]
        unknown = set(parts) - set(columns)
        if unknown:
            raise KeyError(f"{artefact} has no {sorted(unknown)}")
        given = [c for c in columns if c in parts]
        if given != list(columns[: len(given)]):
            raise KeyError(f"{artefact} needs {columns} from the left")
        return "/".join([self.root, artefact, *[f"{c}={parts[c]}" for c in given]])
