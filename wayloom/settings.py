"""Settings of road-map inference. Distances are metres, angles degrees, times seconds."""

from __future__ import annotations

from dataclasses import dataclass

HOUR, DAY = 3600, 86400
INFINITE = float("inf")
CHORD, DUBINS, GRAVITY = 1, 2, 3


@dataclass(frozen=True)
class Settings:
    # clusters
    cluster_radius: float = 30.0
    cluster_move_threshold: float = 3.0
    angular_threshold: float = 30.0
    cluster_merge_radius: float = 15.0
    # waypoints of connections
    intermediate_point_method: int = DUBINS
    chord_angular_tolerance: float = 30.0
    dubins_turning_radius: float = 10.0
    gravity_rounds: int = 15
    gravity_angle: float = 20.0
    # tags
    event_backtrack_time: int = 300
    event_backtrack_distance: float = 100.0
    propagation_time_to_live: int = 600
    proximity_radius: float = 75.0
    auto_tag_gps_points_based_on_equipment_proximity: bool = False
    # removal
    bucket_radius: float = 10.0
    minimum_point_age_for_removal_by_bucket: int = 1800
    minimum_prune_age: int = 12 * HOUR
    maximum_prune_age: int = 7 * DAY
    assume_truck_every_when_pruning: int = DAY
    maximum_connection_count: int = 30
    protected_hop_count_when_pruning: int = 2
    disable_point_pruning: bool = False
    # cadence
    assign_points_every: int = 3000
    update_connections_every: float = INFINITE
    prune_points_every: int = 30000
    final_assign_rounds: int = 20
    final_prepare_rounds: int = 2
    grace: int = 180
    disorder_threshold: int = 10
    # zones
    minimum_zone_votes: int = 2
    stray_hops: int = 15
    meta_hops: int = 4
    direction_change_cost: float = 1e7
    zone_exit_search_depth: int = 10
    # suppression
    improve_multipath: bool = True
    multipath_search_max_path_hops: int = 4
    multipath_search_ignore_zones: bool = True
    minimum_edge_weight: int = 2
    minimum_road_network_component_size: int = 10
    maximum_road_network_component_count: float = INFINITE
    # intersections
    intersection_search_radius: float = 60.0
    intersection_search_angular_threshold: float = 45.0
    roadnetwork_driving_side: str = "left"
    intersection_search_max_path_hops: int = 4
    # pairs
    max_allowed_pair_distance_threshold: float = 200.0
    max_allowed_pair_time_threshold: float = 30.0
    max_allowed_pair_speed: float = 80 / 3.6
    match_epsilon: float = 1e-4

    @property
    def angular_weight(self) -> float:
        """Metres that one degree of heading counts for."""
        return self.cluster_radius / self.angular_threshold
