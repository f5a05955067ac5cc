"""trailmark.sources"""
