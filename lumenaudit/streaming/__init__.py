"""lumenaudit.streaming"""
