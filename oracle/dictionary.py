"""What the dictionary has to say: fixed values, written apart from the Spark code."""

from __future__ import annotations

# table -> column -> (type, meaning, allowed values)
TABLES: dict[str, dict[str, tuple[str, str, tuple[str, ...]]]] = {
    "content": {
        "item_id": ("bigint", "identifier of the item", ()),
        "name": ("string", "title", ()),
        "type": ("string", "format", ("TV", "OVA", "Movie", "Special", "ONA", "Music", "Unknown")),
        "tags": ("string", "comma list of tags", ()),
        "source_material": ("string", "kind of work it is adapted from", ()),
        "source_category": (
            "string", "adapted, original or other",
            ("IP-based", "Original", "Other-IP"),
        ),
        "makers": ("string", "comma list of makers", ()),
        "start_year": ("int", "first year of release", ()),
        "season": ("string", "season of release", ("Winter", "Spring", "Summer", "Fall")),
        "episodes": ("int", "number of episodes", ()),
        "is_digital_native": ("boolean", "released on the web first", ()),
        "community_score": ("double", "mean score of the community, 1 to 10", ()),
        "avg_rating": ("double", "mean rating of completed viewings", ()),
        "median_rating": ("double", "median rating", ()),
        "stddev_rating": ("double", "sample deviation of the ratings", ()),
        "high_rating_ratio": ("double", "share of ratings of 8 or more", ()),
        "low_rating_ratio": ("double", "share of ratings of 4 or less", ()),
        "followers": ("int", "users who keep the item in a list", ()),
        "followers_tier": (
            "string", "tier by percent rank of followers",
            ("Top 1%", "Top 5%", "Top 10%", "Upper Half", "Lower Half"),
        ),
        "favorites": ("int", "users who marked the item as favorite", ()),
        "rating_count": ("bigint", "number of ratings", ()),
        "completion_rate": ("double", "share of list entries completed", ()),
        "drop_rate": ("double", "share of list entries dropped", ()),
        "plan_rate": ("double", "share of list entries planned", ()),
        "completed_users": ("bigint", "list entries completed", ()),
        "dropped_users": ("bigint", "list entries dropped", ()),
        "watching_users": ("bigint", "list entries being watched", ()),
        "has_text": ("boolean", "has a usable text; NULL if the text file lacks the item", ()),
        "text_words": ("bigint", "words of the text", ()),
        "has_ratings": ("boolean", "has been rated", ()),
        "score_rank": ("bigint", "rank by community score, 1 is best", ()),
        "popularity_rank": ("bigint", "rank by followers", ()),
        "completion_rank": ("bigint", "rank by completion rate", ()),
        "engagement_rank": ("bigint", "rank by number of ratings", ()),
        "performance_score": (
            "double", "weighted score of quality, completion, reach and drops",
            (),
        ),
    },
    "users": {
        "user_id": ("bigint", "identifier of the user", ()),
        "user_tier": (
            "string", "tier by percent rank of ratings given",
            ("Power", "Active", "Regular", "Casual"),
        ),
        "total_ratings": ("bigint", "ratings given", ()),
        "unique_items_rated": ("bigint", "distinct items rated", ()),
        "total_list_entries": ("bigint", "list entries", ()),
        "total_watched_episodes": ("bigint", "episodes watched", ()),
        "avg_rating": ("double", "mean rating given", ()),
        "stddev_rating": ("double", "sample deviation of the ratings given", ()),
        "median_rating": ("double", "median rating given", ()),
        "high_rating_ratio": ("double", "share of ratings of 8 or more", ()),
        "low_rating_ratio": ("double", "share of ratings of 4 or less", ()),
        "completed_count": ("bigint", "items completed", ()),
        "watching_count": ("bigint", "items being watched", ()),
        "dropped_count": ("bigint", "items dropped", ()),
        "plan_to_watch_count": ("bigint", "items planned", ()),
        "user_completion_rate": ("double", "share of the user's entries completed", ()),
        "user_drop_rate": ("double", "share of the user's entries dropped", ()),
        "most_watched_tags": ("string", "tag combination rated most often", ()),
        "rating_tendency": (
            "string", "class by mean rating",
            ("Generous", "Moderate", "Critical", "Very Critical"),
        ),
        "viewing_diversity": (
            "string", "class by distinct items",
            ("Explorer", "Regular Viewer", "Selective", "Newcomer"),
        ),
        "drop_tendency": (
            "string", "class by drop rate",
            ("High Dropper", "Moderate Dropper", "Committed Viewer"),
        ),
        "rating_engagement_ratio": ("double", "ratings per list entry", ()),
    },
    "tags": {
        "tag": ("string", "one tag", ()),
        "item_count": ("bigint", "distinct items with the tag", ()),
        "avg_community_score": ("double", "mean community score", ()),
        "avg_user_rating": ("double", "mean of the items' mean ratings", ()),
        "total_followers": ("bigint", "sum of followers", ()),
        "avg_followers": ("double", "mean followers", ()),
        "avg_completion_rate": ("double", "mean completion rate", ()),
        "avg_drop_rate": ("double", "mean drop rate", ()),
        "total_ratings": ("bigint", "sum of ratings", ()),
        "recent_ratio": ("double", "share of listings from 2015 on", ()),
        "popular_ratio": ("double", "share of listings in the top tenth by followers", ()),
        "recent_avg_count": ("double", "mean yearly items 2015 to 2019", ()),
        "prev_avg_count": ("double", "mean yearly items 2010 to 2014", ()),
        "count_growth_rate": ("double", "growth between the two", ()),
        "score_change": ("double", "change of the mean yearly score", ()),
        "trend_category": ("string", "class by growth", ("Growing", "Declining", "Stable")),
        "tag_health_score": ("double", "weighted score of recency, quality, reach, completion", ()),
    },
}
