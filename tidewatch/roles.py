"""Which column plays which part; operators take this instead of fixed column names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    metadata: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    row_id: str = "flow_row_id"
    target: str = "label"
    date: str = "capture_date"

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def without(self, *names: str) -> "Roles":
        """The same roles minus some features (ablation)."""
        return Roles(
            tuple(c for c in self.numeric if c not in names),
            tuple(c for c in self.categorical if c not in names),
            self.metadata, self.excluded, self.row_id, self.target, self.date,
        )


# The column roles of a connection log (dots in names become underscores at the scan).
CONNECTION_LOG = Roles(
    numeric=("id_orig_p", "id_resp_p", "duration", "orig_bytes", "resp_bytes", "missed_bytes",
             "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"),
    categorical=("proto", "service", "conn_state", "history"),
    metadata=("ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "source_file",
              "capture_date", "label", "detailedlabel"),
    excluded=("detailedlabel", "id_orig_h", "id_resp_h", "uid", "source_file", "capture_date",
              "local_orig", "local_resp", "tunnel_parents"),
)

# Class names of the binary task and their codes.
CLASS_CODES = {"Benign": 0, "Malicious": 1}
