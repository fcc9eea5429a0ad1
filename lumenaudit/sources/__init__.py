"""lumenaudit.sources"""
