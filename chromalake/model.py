"""The study container: named experiments, sample rows and metadata; nothing is mutated."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Experiment:
    """Sparse counts with feature and cell tables, embeddings and alternative experiments."""

    counts: DataFrame | None = None
    features: DataFrame | None = None
    cells: DataFrame | None = None
    reduced_dims: dict[str, DataFrame] = field(default_factory=dict)
    alt: dict[str, Experiment] = field(default_factory=dict)

    def with_reduced_dim(self, name: str, embedding: DataFrame, force: bool = False) -> Experiment:
        if name in self.reduced_dims and not force:
            raise ValueError(f"embedding {name} exists")
        return replace(self, reduced_dims={**self.reduced_dims, name: embedding})

    def with_cell_columns(self, columns: DataFrame, key: str = "cell_id") -> Experiment:
        """Left-joins columns onto the cells; columns of the same name are replaced."""
        kept = [c for c in self.cells.columns if c == key or c not in columns.columns]
        return replace(self, cells=self.cells.select(kept).join(columns, key, "left"))


@dataclass(frozen=True)
class Study:
    experiments: dict[str, Experiment] = field(default_factory=dict)
    samples: DataFrame | None = None
    sample_map: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def find(self, name: str) -> Experiment:
        """The experiment of that name, else the first alternative one.

        An alternative experiment takes its parent's cell columns that it lacks; its own win.
        """
        if name in self.experiments:
            return self.experiments[name]
        for parent in self.experiments.values():
            if name in parent.alt:
                child = parent.alt[name]
                if child.cells is None or parent.cells is None:
                    return child
                missing = [c for c in parent.cells.columns if c not in child.cells.columns]
                cells = child.cells.join(parent.cells.select("cell_id", *missing), "cell_id", "left") if missing else child.cells
                return replace(child, cells=cells)
        raise KeyError(f"no experiment {name}")

    def find_reduced_dim(self, name: str, experiment: str | None = None) -> DataFrame:
        """An embedding by name, in one experiment or in the first that has it."""
        pool = {experiment: self.find(experiment)} if experiment else {**self.experiments, **{k: v for e in self.experiments.values() for k, v in e.alt.items()}}
        for e in pool.values():
            if name in e.reduced_dims:
                return e.reduced_dims[name]
        raise KeyError(f"no embedding {name}")

    def replace_experiment(self, name: str, new: Experiment) -> Study:
        """Writes back to where the experiment was found, alternative experiments included."""
        if name in self.experiments:
            return replace(self, experiments={**self.experiments, name: new})
        for parent, e in self.experiments.items():
            if name in e.alt:
                return replace(self, experiments={**self.experiments, parent: replace(e, alt={**e.alt, name: new})})
        raise KeyError(f"no experiment {name}")

    def with_experiment(self, name: str, new: Experiment, sample_column: str = "sample") -> Study:
        """Appends an experiment and rebuilds the sample map; new samples get rows of nulls."""
        if name in self.experiments:
            raise ValueError(f"experiment {name} exists")
        rows, samples = self.sample_map, self.samples
        if new.cells is not None:
            key = sample_column if sample_column in new.cells.columns else "cell_id"
            rows_new = new.cells.select(F.lit(name).alias("assay"), F.col(key).cast("string").alias("primary"), F.col("cell_id").alias("colname"))
            rows = rows_new if rows is None else rows.unionByName(rows_new)
            fresh = rows_new.select(F.col("primary").alias("sample")).distinct()
            if samples is None:
                samples = fresh
            else:
                samples = samples.unionByName(fresh.join(samples.select("sample"), "sample", "left_anti"), allowMissingColumns=True)
        return replace(self, experiments={**self.experiments, name: new}, sample_map=rows, samples=samples)


def create_study(fragments: DataFrame, cells: DataFrame | None = None, tile_width: int = 500, name: str = "TileMatrix500") -> Study:
    """A tile matrix of all fragments of the listed cells, with each cell's depth."""
    from chromalake.operators.counting import cell_depths, tile_counts

    tiles = tile_counts(fragments, tile_width, cells)
    ids = F.concat_ws(":", "seqname", "tile")
    counts = tiles.select(ids.alias("feature_id"), "cell_id", "value")
    ranges = tiles.select(ids.alias("feature_id"), "seqname", (F.col("tile") * tile_width + 1).alias("start"), ((F.col("tile") + 1) * tile_width).alias("end")).distinct()
    depth = cell_depths(fragments)
    if cells is not None:
        depth = depth.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    return Study().with_experiment(name, Experiment(counts, ranges, depth))
