"""Tables that cut lineage: written under the shared checkpoint folder and read again."""

from tallyspark.sources.scratch import only_last_kept, scratch_path, stored

__all__ = ["only_last_kept", "scratch_path", "stored"]
